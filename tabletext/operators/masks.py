"""Personal data in log texts: where it stands, and fixed words in its place.

Numbers, addresses and amounts are looked for on the normalized text; candidates are found by simple shapes and then decided by
their digits and neighbours. People come from the index of ``people``. Of spans that overlap the one that starts first counts,
of these the longest. Places are those of the original text, in characters.

Edge cases: a null text has null spans and stays null; an empty one has none; unknown rules are an error.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions.places import normalized_places
from tabletext.functions.text import EMAIL, _c
from tabletext.operators.people import all_matches, automata_of

# Fixed values.
WORDS = {"email": "［メール］", "phone": "［電話番号］", "amount": "［金額］", "person": "［人名］"}
DEFAULT_RULES = ("email", "phone")
SPANS = "array<struct<start:int,end:int,kind:string>>"

_DASHES = "-‐‑–—―−ー \t"
_EMAIL = re.compile(EMAIL)
_DIALLED = re.compile(f"[+(]?[0-9][0-9(){_DASHES}]*")
_GROUP = re.compile("[0-9]+")
_EXTENSION = re.compile("(?:内線|ext\\.?)[ :]*[0-9]{2,6}(?![0-9])", re.IGNORECASE)
_NUMBER = re.compile("[0-9][0-9,]*(?:\\.[0-9]+)?")


def _is_phone(number: str) -> bool:
    """Whether a run of groups of digits is a number to call: of the country with +81, or with a leading 0."""
    groups = _GROUP.findall(number)
    digits = "".join(groups)
    if number.startswith("+"):
        return digits.startswith("81") and len(digits[2:].lstrip("0")) in (9, 10)
    if not digits.startswith("0"):
        return False
    if len(groups) == 1:
        return len(digits) in (10, 11)
    joined = len(groups) == 2 and number.startswith("(")
    return (len(groups) == 3 or joined) and 9 <= len(digits) <= 11 and len(groups[-1]) in (3, 4) and all(len(g) <= 5 for g in groups)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIALLED.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".-/"):
            continue
        ends = [m.start() + g.end() for g in _GROUP.finditer(m.group())]
        for end in reversed(ends[:4]):  # the longest run of groups that is a number
            if _is_phone(text[m.start() : end]):
                yield m.start(), end
                break
    for m in _EXTENSION.finditer(text):
        yield m.span()


def _amounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBER.finditer(text):
        before = text[: m.start()].rstrip(" ") if text[max(0, m.start() - 4) : m.start()].rstrip(" ").endswith("¥") else ""
        unit = re.match(" *(万円|円)", text[m.end() : m.end() + 6])
        if before:
            yield len(before) - 1, m.end()
        elif unit and not text[max(0, m.start() - 1) : m.start()].endswith((".", ",")):
            yield m.start(), m.end() + unit.end()


def spans_in(text: str, rules: tuple[str, ...], automata: list) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the original text."""
    plain, starts, ends = normalized_places(text)
    found = []
    if "email" in rules:
        found += [(m.start(), -m.end(), "email") for m in _EMAIL.finditer(plain)]
    if "phone" in rules:
        found += [(a, -b, "phone") for a, b in _phones(plain)]
    if "amount" in rules:
        found += [(a, -b, "amount") for a, b in _amounts(plain)]
    if "person" in rules:
        found += [(m[0], m[1], "person") for m in all_matches(automata, plain) if m[4] != "group"]  # an earlier span of another kind may cover the first of two
    out: list[tuple[int, int, str]] = []
    stop = 0
    for start, end, kind in sorted(found):
        if starts[start] >= stop:
            stop = ends[-end - 1]
            out.append((starts[start], stop, kind))
    return out


def find_masks(df: DataFrame, text: str, rules: tuple[str, ...] = DEFAULT_RULES, people: DataFrame | None = None, out: str = "masks") -> DataFrame:
    """Adds the ``SPANS`` of a text; ``people`` is an index of ``people.people_index``, for the rule ``person``."""
    if unknown := set(rules) - set(WORDS):
        raise ValueError(f"unknown rules {sorted(unknown)}")
    sc = df.sparkSession.sparkContext
    held = [sc.broadcast(a) for a in automata_of(people)] if people is not None and "person" in rules else []

    @F.arrow_udf(SPANS)
    def find(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [b.value for b in held]
        for texts in values:
            made = [None if t is None else spans_in(t, rules, automata) for t in texts.to_pylist()]
            flat = [x for spans in made for x in spans or ()]
            fields = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            ends = pa.array([0, *itertools.accumulate(len(spans or ()) for spans in made)], pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["start", "end", "kind"]), mask=pa.array([spans is None for spans in made]))

    return df.withColumn(out, find(F.col(text)))


def masked(text: Column | str, masks: Column | str = "masks") -> Column:
    """The text with a fixed word in the place of each span."""
    t, spans = _c(text), _c(masks)
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    # what lies before each span, with its word, and what lies behind the last one
    end_before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    before = F.transform(spans, lambda s, i: F.concat(F.substring(t, end_before(i) + 1, s["start"] - end_before(i)), words[s["kind"]]))
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(before, ""), F.substring(t, last + 1, F.length(t)))).otherwise(t)
