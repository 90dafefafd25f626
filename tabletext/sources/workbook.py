"""Workbook (.xlsx) rows with the standard library: zip parts, shared strings, styles, merges, hidden rows and links."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from tabletext.sources.encodings import MAX_COLUMNS, SourceError

MAX_RATIO, MAX_PART_BYTES, MAX_CELLS, MAX_MERGED = 100, 1 << 30, 500_000, 2_000_000
# Built-in number formats by number.
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "yyyy/m/d", 15: "d-mmm-yy", 16: "d-mmm",
    17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 49: "@",
}
_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def precheck(data: bytes) -> None:
    """Refuse what would unpack to far more than it holds, without unpacking it."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise SourceError("not a workbook") from e
    total = sum(i.file_size for i in z.infolist())
    if total > MAX_PART_BYTES or total > MAX_RATIO * max(len(data), 1 << 16):
        raise SourceError("the workbook unpacks to too much data")
    if "xl/workbook.xml" not in z.namelist():
        raise SourceError("not a workbook of the supported kind")


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.namelist():
        return None
    data = z.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data[:4096]:
        raise SourceError("document types are not read")
    return ET.fromstring(data)


def _strings(z: zipfile.ZipFile) -> list[str]:
    root = _xml(z, "xl/sharedStrings.xml")
    return [] if root is None else [_rich(si) for si in root if _local(si.tag) == "si"]


def _rich(node: ET.Element) -> str:
    """Text of a string item: plain or runs, without phonetic runs."""
    out = []
    for child in node:
        kind = _local(child.tag)
        if kind == "t":
            out.append(child.text or "")
        elif kind == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def _styles(z: zipfile.ZipFile) -> list[tuple[str, bool, bool]]:
    """(number format, bold, struck out) of each cell style."""
    root = _xml(z, "xl/styles.xml")
    if root is None:
        return []
    part = {_local(c.tag): c for c in root}
    formats = dict(BUILTIN_FORMATS) | {int(f.get("numFmtId")): f.get("formatCode") for f in part.get("numFmts", [])}

    def on(font: ET.Element, name: str) -> bool:
        return any(_local(c.tag) == name and c.get("val", "1") not in ("0", "false") for c in font)

    fonts = [(on(f, "b"), on(f, "strike")) for f in part.get("fonts", [])]
    out = []
    for xf in part.get("cellXfs", []):
        font = int(xf.get("fontId", 0))
        out.append((formats.get(int(xf.get("numFmtId", 0)), "General"), *(fonts[font] if font < len(fonts) else (False, False))))
    return out


def is_date_format(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h|m|s)[^\]]*\]', "", code.split(";")[0], flags=re.IGNORECASE).lower()
    return code != "General" and bool(re.search(r"[ymdhs]|am/pm", bare)) and not re.fullmatch(r"[#0.,%e+\-() ]*", bare)


def serial_text(value: float, code: str, date1904: bool) -> tuple[str, str]:
    """(kind, text) of a serial number under a date or time format."""
    bare = re.sub(r'"[^"]*"', "", code).lower()
    if re.search(r"\[h+\]|\[m+\]|\[s+\]", bare):
        seconds = round(value * 86400)
        return "duration", f"{seconds // 3600}:{seconds % 3600 // 60:02d}" + (f":{seconds % 60:02d}" if seconds % 60 else "")
    seconds = round(value % 1 * 86400)
    days = int(value // 1) + seconds // 86400
    seconds %= 86400
    clock = f"{seconds // 3600:02d}:{seconds % 3600 // 60:02d}" + (f":{seconds % 60:02d}" if seconds % 60 else "")
    if 0 <= value < 1 and not re.search(r"[yd]", bare):
        return "time", clock
    if not date1904 and days < 60:
        days += 1  # the calendar of 1900 has a day too many
    day = (dt.date(1904, 1, 1) if date1904 else dt.date(1899, 12, 30)) + dt.timedelta(days=days)
    return ("datetime", f"{day} {clock}") if seconds else ("date", str(day))


def number_text(raw: str) -> str:
    """A number as it is shown: whole ones without a fraction, others to ten places."""
    value = float(raw)
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return repr(round(value, 10))


def column_number(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as ``B7``; the column counts from 0."""
    letters, digits = re.match(r"([A-Z]*)([0-9]*)", ref).groups()
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return int(digits or 0), n - 1


def _area(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    (r1, c1), (r2, c2) = column_number(a), column_number(b or a)
    return r1, c1, r2, c2


def _links(z: zipfile.ZipFile, part: str, found: list[dict]) -> dict[tuple[int, int], str]:
    folder, _, name = part.rpartition("/")
    rels = _xml(z, f"{folder}/_rels/{name}.rels")
    targets = {} if rels is None else {r.get("Id"): r.get("Target") for r in rels}
    out = {}
    for link in found:
        ident = next((v for k, v in link.items() if _local(k) == "id"), None)
        target = (targets.get(ident) or "") + (f"#{link['location']}" if link.get("location") else "")
        r1, c1, _, _ = _area(link["ref"])
        if target:
            out[r1, c1] = target[:500]
    return out


def rows(data: bytes, wanted: list[str] | None = None) -> Iterator[dict]:
    """Rows of the sheets in order, blank rows between included."""
    precheck(data)
    z = zipfile.ZipFile(io.BytesIO(data))
    book = _xml(z, "xl/workbook.xml")
    rels = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    date1904 = any(_local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in book.iter())
    strings, styles = _strings(z), _styles(z)
    for sheet in [n for n in book.iter() if _local(n.tag) == "sheet"]:
        if wanted and sheet.get("name") not in wanted:
            continue
        target = rels[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        yield from _sheet_rows(z, part, sheet.get("name"), strings, styles, date1904)


def _cell(node: ET.Element, strings: list[str], styles: list[tuple[str, bool, bool]], date1904: bool) -> dict:
    style = int(node.get("s", 0))
    code, bold, strike = styles[style] if style < len(styles) else ("General", False, False)
    kind, raw, inline = node.get("t", "n"), None, None
    for child in node:
        if _local(child.tag) == "v":
            raw = child.text
        elif _local(child.tag) == "is":
            inline = _rich(child)
    out = {"number_format": code, "bold": bold, "strike": strike}
    if kind == "inlineStr":
        kind, text = "string", inline
    elif raw is None:
        kind, text = "blank", None
    elif kind == "s":
        kind, text = "string", strings[int(raw)] if int(raw) < len(strings) else ""
    elif kind == "b":
        kind, text = "bool", "TRUE" if raw == "1" else "FALSE"
    elif kind == "e":
        kind, text = "error", raw
    elif kind == "n" and _NUMBER.fullmatch(raw):
        kind, text = serial_text(float(raw), code, date1904) if is_date_format(code) else ("number", number_text(raw))
    else:
        kind, text = "string", raw
    text = re.sub(r"\r\n?", "\n", text).strip() if text else None
    return out | {"kind": kind if text else "blank", "text": text}


def _sheet_rows(z: zipfile.ZipFile, part: str, name: str, strings: list[str], styles: list, date1904: bool) -> Iterator[dict]:
    merges: list[tuple[int, int, int, int]] = []
    links: list[dict] = []
    found: dict[int, tuple[bool, dict[int, dict]]] = {}
    row_no, n_cells = 0, 0
    with z.open(part) as f:
        for _, node in ET.iterparse(f):
            kind = _local(node.tag)
            if kind == "row":
                row_no = int(node.get("r", row_no + 1))
                cells: dict[int, dict] = {}
                at = -1
                for c in node:
                    at = column_number(c.get("r"))[1] if c.get("r") else at + 1
                    cell = _cell(c, strings, styles, date1904)
                    if cell["text"] is not None or cell["strike"]:
                        cells[at] = cell
                n_cells += len(cells)
                if n_cells > MAX_CELLS or max(cells, default=0) >= MAX_COLUMNS:
                    raise SourceError(f"sheet {name} is too large")
                found[row_no] = (node.get("hidden") in ("1", "true"), cells)
                node.clear()
            elif kind == "mergeCell":
                merges.append(_area(node.get("ref")))
            elif kind == "hyperlink":
                links.append(dict(node.attrib))
    if sum((r2 - r1 + 1) * (c2 - c1 + 1) for r1, c1, r2, c2 in merges) > MAX_MERGED:
        raise SourceError(f"sheet {name} has too many merged cells")
    targets = _links(z, part, links)
    anchors: dict[int, dict[int, tuple[int, int]]] = {}
    last = max(found, default=0)
    for r1, c1, r2, c2 in merges:
        for r in range(r1, min(r2, last) + 1):
            for c in range(c1, min(c2, MAX_COLUMNS - 1) + 1):
                anchors.setdefault(r, {})[c] = (r1, c1)
    for r in range(1, last + 1):
        hidden, cells = found.get(r, (False, {}))
        own = anchors.get(r, {})
        width = max([*cells, *own, *[c for rr, c in targets if rr == r], -1]) + 1
        out = []
        for c in range(width):
            cell = dict(cells.get(c) or {"kind": "blank", "text": None})
            anchor = own.get(c)
            if anchor and anchor != (r, c):
                cell |= {"kind": "blank", "text": None}  # only the anchor of merged cells holds a value
            if anchor:
                cell |= {"anchor_row": anchor[0], "anchor_col": anchor[1]}
            out.append(cell | {"link": targets.get((r, c))})
        yield {"sheet": name, "row_index": r, "hidden": hidden, "cells": out}
