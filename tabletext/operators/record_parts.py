"""Records over a token budget to parts that each say whose they are.

A record is a title and lines: bullets (``- label: value``) with the indented lines below them. A part that is not the first
starts with the title and its number, the short lines that tell the record (key, entity, date), and, if it starts inside a
bullet, that bullet's label. These repeats count in the part's budget. Weights of lines are whole thirtieths of a token, so
that running sums give the weight of any run of lines, and each cut is found by bisection in them.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions.text import _c, estimate_tokens, let
from tabletext.operators.documents import BLOCK_TOKENS, TokenCounts, text_pieces

#: Weights of a token and of a line feed, in thirtieths.
TOKEN, FEED = 30, 15
#: Tokens that repeats leave to a part's own lines, at least.
OWN_TOKENS = 80
#: Characters of a label and of a value that are repeated, steps by which they are shortened.
LABEL_CHARS, VALUE_CHARS = 20, (60, 20, 0)
LINES = "array<struct<part:int,text:string,source:string,goes_on:boolean>>"


@dataclass
class Line:
    """A line as it is shown, the characters of the record in it, whether it goes on the line before, and its bullet's number and label."""

    text: str
    source: str
    goes_on: bool
    bullet: int
    again: str


_WIDE, _DIGITS, _RUNS, _MARKS = (re.compile(p) for p in ("[^\\x00-\\x7F]+", "[0-9]", "[0-9]+", "[!-/:-@\\[-`{-~]"))


def weight(text: str) -> int:
    """What ``TokenCounts`` sums up to, for short texts."""
    if len(text) > 2000:
        return TokenCounts(text).sums[-1]
    wide = 0 if text.isascii() else len(text) - len(_WIDE.sub("", text))
    return 15 * len(text) + 18 * wide + 15 * len(_MARKS.findall(text)) - 5 * len(_DIGITS.findall(text)) + 30 * len(_RUNS.findall(text))


def _clipped(text: str, chars: int) -> str:
    return text if len(text) <= chars else f"{text[: max(0, chars - 1)]}…"


def head(title: str, part: int, parts: int) -> str:
    """The title of a part."""
    if parts == 1:
        return title
    return f"{title}（{'続き' if part > 1 else ''}{part}/{parts}）"


def repeated(lines: list[str], room: int) -> list[str]:
    """Lines that are repeated, their values shortened until all fit the room; those that never fit are left out."""
    for chars in VALUE_CHARS:
        out = []
        for line in lines:
            label, colon, value = line.partition(": ")
            out.append(f"{_clipped(label, LABEL_CHARS + 2)}{colon}{_clipped(value, chars)}" if len(line) > 2 * chars else line)
        if sum(weight(x) + FEED for x in out) <= room:
            return out
    kept: list[str] = []
    for line in out:
        if sum(weight(x) + FEED for x in [*kept, line]) <= room:
            kept.append(line)
    return kept


def _label_of(line: str) -> str:
    """What a part says that goes on a bullet: its label, shortened."""
    label = line[2:].partition(": ")[0] if ": " in line else line[2:].rstrip(":")
    return f"- {_clipped(label, LABEL_CHARS)}（続き）:"


def shown_lines(body: list[str], room: int) -> list[Line]:
    """The lines of a record, those over the room cut behind sentences, commas, spaces or characters."""
    out: list[Line] = []
    bullet, again = -1, ""
    for line in body:
        first = line.startswith("- ") or bullet < 0
        if first:
            bullet += 1
            again = _label_of(line) if line.startswith("- ") else ""
        own = room if first or not again else room - weight(again) - FEED
        if weight(line) <= own:
            out.append(Line(line, line, False, bullet, again))
            continue
        # behind the label of a bullet or the indent of a line; pieces are shown behind these again
        value = line.find(": ") + 2 if first and again and 0 < line.find(": ") < LABEL_CHARS * 4 else len(line) - len(line.lstrip(" "))
        lead, before = line[:value], f"{again} " if first and again else line[:value]
        fits = max(1, (own - max(weight(lead), weight(before))) // TOKEN)
        for k, piece in enumerate(text_pieces(line[value:], fits)):
            out.append(Line((before if k else lead) + piece, piece if k else lead + piece, k > 0, bullet, "" if first else again))
    return out


def packed(lines: list[Line], room: int) -> list[int]:
    """Where parts start: each takes what fits, and ends between bullets unless the next bullet is larger than a part."""
    sums = [0, *itertools.accumulate(weight(x.text) + FEED for x in lines)]
    starts_of = [i for i, x in enumerate(lines) if i == 0 or x.bullet != lines[i - 1].bullet]
    cuts, at = [], 0
    while at < len(lines):
        cuts.append(at)
        inside = at > 0 and lines[at].bullet == lines[at - 1].bullet
        repeat = weight(lines[at].again) + FEED if inside and lines[at].again else 0
        end = max(at + 1, bisect.bisect_right(sums, sums[at] + room - repeat) - 1)
        if end < len(lines):
            k = bisect.bisect_right(starts_of, end) - 1
            start = starts_of[k]
            stop = starts_of[k + 1] if k + 1 < len(starts_of) else len(lines)
            if start > at and sums[stop] - sums[start] <= room:
                end = start
        at = end
    return cuts


def record_parts(title: str, body: list[str], repeats: list[str], budget: int = BLOCK_TOKENS) -> list[tuple[int, str, str | None, bool]]:
    """(part, line, characters of the record in it or null for what is repeated, whether it goes on the line before) of every line."""
    whole = sum(weight(x) + FEED for x in body) + weight(title)
    if whole <= budget * TOKEN:
        return [(1, title, None, False), *[(1, line, line, False) for line in body]]
    digits = 1
    while True:
        number = "9" * digits
        most = budget * TOKEN - weight(f"{title}（続き{number}/{number}）") - FEED
        again = repeated(repeats, most - OWN_TOKENS * TOKEN)
        room = most - sum(weight(x) + FEED for x in again)
        lines = shown_lines(body, room - FEED)
        cuts = packed(lines, room)
        if len(str(len(cuts))) <= digits:
            break
        digits += 1
    out: list[tuple[int, str, str | None, bool]] = []
    for part, (i, j) in enumerate(itertools.pairwise([*cuts, len(lines)]), 1):
        out.append((part, head(title, part, len(cuts)), None, False))
        own = {x.text for x in lines[i:j]}
        out += [(part, x, None, False) for x in again if part > 1 and x not in own]
        if i and lines[i].again and lines[i].bullet == lines[i - 1].bullet:
            out.append((part, lines[i].again, None, False))
        out += [(part, x.text, x.source, x.goes_on) for x in lines[i:j]]
    return out


def split_records(df: DataFrame, title: str, body: str, repeats: str, budget: int = BLOCK_TOKENS, out: str = "lines") -> DataFrame:
    """Adds the lines of the parts of each record (``LINES``); ``body`` and ``repeats`` are arrays of lines.

    A record within the budget stays whole and never comes to a Python worker's packing. Null titles and arrays are empty.
    A title over 200 characters must be clipped before; a part then never exceeds the budget.
    """

    @F.pandas_udf(LINES)
    def parts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for r in rows:
            made = [
                None if b is None else [dict(zip(("part", "text", "source", "goes_on"), x, strict=True)) for x in record_parts(t, list(b), list(again), budget)]
                for t, b, again in zip(r["title"], r["body"], r["repeats"], strict=True)
            ]
            yield pd.Series(made, index=r.index, dtype=object)

    none = F.array().cast("array<string>")
    shown = df.withColumn("parts_title", F.coalesce(F.col(title), F.lit(""))).withColumn("parts_body", F.coalesce(F.col(body), none)).withColumn("parts_again", F.coalesce(F.col(repeats), none))
    text = F.array_join(F.concat(F.array("parts_title"), "parts_body"), "\n")
    fits = estimate_tokens(text) <= budget
    line = lambda t, s: F.struct(F.lit(1).alias("part"), t.alias("text"), s.alias("source"), F.lit(False).alias("goes_on"))
    whole = F.concat(F.array(line(F.col("parts_title"), F.lit(None).cast("string"))), F.transform("parts_body", lambda x: line(x, x)))
    long = F.struct(F.col("parts_title").alias("title"), F.when(~fits, F.col("parts_body")).alias("body"), F.col("parts_again").alias("repeats"))
    return shown.withColumn("parts_long", parts(long)).withColumn(out, F.coalesce("parts_long", whole)).drop("parts_title", "parts_body", "parts_again", "parts_long")


def part_texts(lines: Column | str) -> Column:
    """The text of each part."""
    # the lines stand in the order of their parts, and each part is a run of them
    def of(l: Column) -> Column:  # noqa: E741
        return let(F.filter(F.transform(l, lambda x, i: F.when((i == 0) | (x["part"] != F.get(l, i - 1)["part"]), i)), lambda i: i.isNotNull()), lambda starts: F.transform(
            starts, lambda a, k: F.array_join(F.transform(F.slice(l, a + 1, F.coalesce(F.get(starts, k + 1), F.size(l)) - a), lambda x: x["text"]), "\n")
        ))

    return let(_c(lines), of)


def restored(lines: Column | str) -> Column:
    """The record's own lines without what parts repeat, as one text."""
    own = F.filter(_c(lines), lambda x: x["source"].isNotNull())
    return F.array_join(F.transform(own, lambda x, i: F.concat(F.when((i == 0) | x["goes_on"], "").otherwise("\n"), x["source"])), "")
