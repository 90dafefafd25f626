"""Titles, clips, code parts, units of formats and year contexts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletext.functions.text import _c, let, one_line

# Fixed values.
BRACKETS = {"(": ")", "（": "）", "[": "]", "［": "］", "「": "」", "『": "』", "【": "】", "〔": "〕"}
ERA_START = {"令和": 2018, "R": 2018, "平成": 1988, "H": 1988}


def _first_open(head: Column) -> Column:
    """Place (from 0) of the first opening bracket of a text that no later one of its kind closes, null if there is none.

    Read from the right, a closing bracket waits for its opening one; an opening bracket for which none waits is open.
    """
    openers, closers = F.array(*[F.lit(c) for c in BRACKETS]), F.array(*[F.lit(c) for c in BRACKETS.values()])
    start = F.struct(F.array(*[F.lit(0) for _ in BRACKETS]).alias("waiting"), F.lit(None).cast("int").alias("first"))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(head, i, F.lit(1))
        closing, opening = F.array_position(closers, c), F.array_position(openers, c)
        met = F.try_element_at(acc["waiting"], F.when(opening > 0, opening).cast("int"))
        change = F.when(closing > 0, 1).when(met > 0, -1).otherwise(0)
        kind = F.greatest(closing, opening) - 1
        waiting = F.when(change == 0, acc["waiting"]).otherwise(F.transform(acc["waiting"], lambda n, k: n + F.when(k == kind, change).otherwise(0)))
        return F.struct(waiting.alias("waiting"), F.when((opening > 0) & (met == 0), (i - 1).cast("int")).otherwise(acc["first"]).alias("first"))

    places = F.reverse(F.sequence(F.lit(1), F.length(head)))
    return F.when(head.rlike(f"[{re.escape(''.join(BRACKETS))}]"), F.aggregate(places, start, step, lambda acc: acc["first"]))


def clip_title(c: Column | str, limit: int) -> Column:
    """Cut to ``limit`` characters and an ellipsis, before a bracket that stays open if it opens in the second half; 0: no limit."""
    if limit <= 0:
        return _c(c)

    def kept(head: Column, opened: Column) -> Column:
        before = F.when(opened >= limit // 2, F.substring(head, F.lit(1), opened)).otherwise(head)
        tidy = F.regexp_replace(before, "(?U)[\\s、,。.]*[、,。.]$|(?U)\\s+$", "")
        return let(tidy, lambda t: F.when(t == "", F.regexp_replace(head, "(?U)\\s+$", "")).otherwise(t))

    def cut(text: Column) -> Column:
        head = F.substring(text, 1, limit)
        short = let(head, lambda h: let(_first_open(h), lambda opened: kept(h, opened)))
        return F.when(F.length(text) > limit, F.concat(short, F.lit("…"))).otherwise(text)

    return let(_c(c), cut)


def title_line(c: Column | str) -> Column:
    """The first line of a text that holds more than a date, time or tag, without these."""

    def bare(line: Column) -> Column:
        line = F.regexp_replace(line, "^[・●■◆\\s]*", "")
        line = F.regexp_replace(line, "^[12][0-9]{3}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?\\s*(?:[0-2]?[0-9]:[0-5][0-9])?\\s*", "")
        return one_line(F.regexp_replace(line, "^[【\\[][^】\\]]{1,12}[】\\]]\\s*", ""))

    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(_c(c), "\n"), bare), lambda x: x != ""), F.lit(1)), F.lit(""))


def record_title(key: Column | str, name: Column | str, code: Column | str, text: Column | str, date: Column | str, limit: int = 200) -> Column:
    """``【key】name（code）text｜date``, parts left out where they are blank; a space only behind a name that no bracket ends."""
    part = lambda c, a, b: F.when(F.coalesce(_c(c), F.lit("")) != "", F.concat(F.lit(a), _c(c), F.lit(b))).otherwise(F.lit(""))

    def joined(head: Column, line: Column) -> Column:
        space = F.when((head == "") | (line == "") | head.rlike("[】）]$"), "").otherwise(" ")
        return F.concat(head, space, line, part(date, "｜", ""))

    head = F.concat(part(key, "【", "】"), part(name, "", ""), part(code, "（", "）"))
    line = F.coalesce(clip_title(title_line(text), 40), F.lit(""))
    return clip_title(let(head, lambda h: let(line, lambda x: joined(h, x))), limit)


def upper_code(c: Column | str) -> Column:
    """Capitals for the leading code of a cell, the rest as it is."""
    head = F.regexp_extract(_c(c), "^([A-Za-z]{1,6}[-_]?[0-9][A-Za-z0-9-]*)", 1)
    return F.concat(F.upper(head), F.substring(_c(c), F.length(head) + 1, F.length(_c(c))))


def format_unit(c: Column | str) -> Column:
    """Unit that a number format writes behind the number: a quoted text, or the percent sign."""
    quoted = F.regexp_extract(_c(c), "[0#]\\s*\"([^\"]{1,6})\"", 1)
    return F.when(quoted != "", F.trim(quoted)).when(_c(c).rlike("%"), "%").otherwise(F.lit(""))


_YEAR, _MONTH, _GAP = "[12][0-9]{3}", "(?:1[0-2]|0?[1-9])", "\\s*[年/.\\-_]\\s*"
#: What names a year, in order of weight: (kind, pattern). ``e`` is an era, ``n`` its year, ``y`` a year, ``m`` a month.
_NAMES = [
    ("fiscal_year", f"(?<![0-9])(?P<y>{_YEAR})\\s*年度"),
    ("fiscal_year", f"(?i:FY)\\s*(?P<y>{_YEAR})"),
    ("fiscal_year", f"(?P<e>{'|'.join(ERA_START)})\\s*(?P<n>[0-9]{{1,2}}|元)\\s*年度"),
    ("year", f"(?<![0-9])(?P<y>{_YEAR}){_GAP}(?P<m>{_MONTH})(?![0-9])"),
    ("year", "(?<![0-9])(?P<y>(?:19|20|21)[0-9]{2})(?P<m>0[1-9]|1[0-2])(?![0-9])"),
    ("year", f"(?<![A-Za-z])(?P<e>[RH])(?P<n>[0-9]{{1,2}})[.\\-_](?P<m>{_MONTH})(?![0-9])"),
    ("year", f"(?<![0-9])(?P<y>{_YEAR})\\s*年"),
]
_NAMES = [(kind, re.compile(pattern)) for kind, pattern in _NAMES]


def _named_years(text: str) -> Iterator[dict]:
    for kind, pattern in _NAMES:
        for m in pattern.finditer(text):
            part = m.groupdict()
            year = int(part["y"]) if part.get("y") else ERA_START[part["e"]] + int(part["n"].replace("元", "1"))
            if 1950 <= year <= 2100:
                yield {kind: year} | ({"month": int(part["m"])} if part.get("m") else {})


def year_context(sources: list[tuple[str, str]]) -> dict:
    """Fiscal year, or year and month, from the first of (label, text) that names one between 1950 and 2100."""
    none = {"fiscal_year": None, "year": None, "month": None, "source": ""}
    named = ({"source": label} | found for label, raw in sources for found in _named_years(unicodedata.normalize("NFKC", raw or "")))
    return none | next(named, {})
