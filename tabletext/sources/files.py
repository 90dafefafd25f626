"""Files to ordered rows of cells: delimited text and workbooks, one task a file.

A quoted field may hold line ends, and a row's number is part of its meaning, so a file is read from its start by one
task; many files are read side by side. Sizes are bounded as in an upload: ``MAX_FILE_BYTES``.
"""

from __future__ import annotations

import csv
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.sources import encodings, workbook

MAX_FILE_BYTES = 200 << 20
BATCH_ROWS = 2000
CELL = pa.struct([
    ("kind", pa.string()), ("text", pa.string()), ("number_format", pa.string()), ("bold", pa.bool_()), ("strike", pa.bool_()),
    ("anchor_row", pa.int32()), ("anchor_col", pa.int32()), ("link", pa.string()),
])
ROWS = (
    "file string, sheet string, row_index int, hidden boolean, cells array<struct<kind string, text string, number_format string, bold boolean, "
    "strike boolean, anchor_row int, anchor_col int, link string>>, notes array<string>, error string"
)
_LINE_END, _INVISIBLE = re.compile(r"\r\n?"), re.compile("[\x00-\x08\x0b-\x1f\x7f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_EXCEL_TEXT = re.compile(r'^="(.*)"$', re.DOTALL)
_SCHEMA = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row_index", pa.int32()), ("hidden", pa.bool_()), ("cells", pa.list_(CELL)), ("notes", pa.list_(pa.string())), ("error", pa.string())])


def clean_cell(raw: str | None) -> str | None:
    """A cell's text: line ends, controls and outer white space tidied, ``="..."`` unwrapped, empty as none."""
    if raw is None:
        return None
    text = raw.replace("_x000D_", "") if "_x000D_" in raw else raw
    if not text.isprintable():  # line ends, controls and invisible characters are not
        text = _INVISIBLE.sub("", _LINE_END.sub("\n", text))
    text = text.strip()
    wrapped = text.startswith('="') and _EXCEL_TEXT.match(text)
    text = wrapped[1].replace('""', '"') if wrapped else text
    return text or None


def _batch(out: list[dict]) -> pa.RecordBatch:
    """Rows as columns; the cells of all rows as one run, of which absent fields are not built cell by cell."""
    cells = [c for row in out for c in row.get("cells") or ()]
    fields = [pa.array([c.get(f.name) for c in cells], f.type) if f.name in ("kind", "text") or any(f.name in c for c in cells) else pa.nulls(len(cells), f.type) for f in CELL]
    ends = pa.array([0, *itertools.accumulate(len(row.get("cells") or ()) for row in out)], pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(CELL)), mask=pa.array([row.get("cells") is None for row in out]))
    return pa.RecordBatch.from_arrays([lists.cast(f.type) if f.name == "cells" else pa.array([row.get(f.name) for row in out], f.type) for f in _SCHEMA], schema=_SCHEMA)


def delimited_rows(data: bytes, name: str, encoding: str | None, delimiter: str | None, strict: bool) -> Iterator[dict]:
    dialect = encodings.sniff(data, name)
    encoding, delimiter = encoding or dialect.encoding, delimiter or dialect.delimiter
    text = encodings.decode(data, encoding, strict)
    replaced = not strict and (encoding != dialect.encoding or dialect.error_line is not None)
    for i, (row, notes) in enumerate(encodings.noted_records(text, delimiter), 1):
        if len(row) > encodings.MAX_COLUMNS:
            raise encodings.SourceError(f"record {i} has {len(row)} columns")
        notes += ["replaced_chars"] if replaced and any(encodings.GETA in c for c in row) else []
        if any(encodings.MIXED in c for c in row):
            notes += ["mixed_encoding"]
            row = [c.replace(encodings.MIXED, "") for c in row]
        cells = [{"kind": "blank" if c is None else "string", "text": c} for c in map(clean_cell, row)]
        yield {"sheet": "", "row_index": i, "hidden": None, "cells": cells, "notes": notes}


def read_files(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, strict: bool = False, sheets: list[str] | None = None
) -> DataFrame:
    """(file, sheet, row_index, hidden, cells, notes, error) of all files under a path or glob.

    The kind is taken from the extension. A file that cannot be read gives one row with ``error`` set.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= MAX_FILE_BYTES, F.col("content")).alias("content"))

    def rows_of(name: str, data: bytes) -> Iterator[dict]:
        ext = name.lower().rsplit(".", 1)[-1]
        if ext in ("xlsx", "xlsm"):
            return workbook.rows(data, sheets)
        if ext in ("csv", "tsv", "txt"):
            return delimited_rows(data, name, encoding, delimiter, strict)
        raise encodings.SourceError(f"files of type .{ext} are not read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                out: list[dict] = []
                try:
                    if data.as_py() is None:
                        raise encodings.SourceError("larger than the limit")
                    for row in rows_of(path_, data.as_py()):
                        out.append({"file": path_, "error": None} | row)
                        if len(out) >= BATCH_ROWS:
                            yield _batch(out)
                            out = []
                except (encodings.SourceError, UnicodeError, csv.Error) as e:
                    out.append({"file": path_, "sheet": None, "row_index": None, "hidden": None, "cells": None, "notes": None, "error": str(e)})
                if out:
                    yield _batch(out)

    return files.mapInArrow(run, ROWS)


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a delimited file: its dialect, digest and size."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_FILE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path_, sha, data in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                try:
                    out.append({"file": path_, "sha256": sha, "error": None} | encodings.sniff(data, path_).asdict())
                except encodings.SourceError as e:
                    out.append({"file": path_, "sha256": sha, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, _SNIFF)

    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(
        run,
        "file string, sha256 string, encoding string, bom boolean, delimiter string, header_record int, trailer_records int, confidence double, error_line int, columns int, error string",
    )


_SNIFF = pa.schema([
    ("file", pa.string()), ("sha256", pa.string()), ("encoding", pa.string()), ("bom", pa.bool_()), ("delimiter", pa.string()), ("header_record", pa.int32()),
    ("trailer_records", pa.int32()), ("confidence", pa.float64()), ("error_line", pa.int32()), ("columns", pa.int32()), ("error", pa.string()),
])
