"""Text functions of the record engine as Column expressions (no Python workers)."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
DITTO_MARKS = ["〃", "々", "\"", "''", "″", "”", "“", "同上", "同", "仝", "〻", "ヽ", "ゝ"]
NA_TOKENS = ["", "-", "--", "ー", "―", "—", "n/a", "na", "none", "null", "なし", "該当なし"]
EXCEL_ERRORS = ["#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!"]
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
INVISIBLE = "[\\u00AD\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u2069\\uFEFF]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


@F.pandas_udf(T.StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC by Arrow batches; Spark has no such function. Null stays null."""
    for s in values:
        yield s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


_CIRCLED = re.compile("[" + "".join(c for c in map(chr, [*range(0x2460, 0x3400), *range(0x1F100, 0x1F300)]) if unicodedata.decomposition(c).startswith("<circle>")) + "]")
#: Characters beside which NFKC may change a text: all but ASCII, letters of Latin-1, kana, common ideographs and marks of them.
UNSTABLE = "[^\\x00-\\x7F\\u00C0-\\u00FF\\u3001-\\u3003\\u3008-\\u3011\\u3041-\\u3096\\u30A1-\\u30FC\\u4E00-\\u9FFF]"


def _keep_enclosed(t: str | None) -> str | None:
    if t is None or unicodedata.is_normalized("NFKC", t):
        return t
    if not _CIRCLED.search(t):
        return unicodedata.normalize("NFKC", t)
    return unicodedata.normalize("NFC", "".join(c if _CIRCLED.match(c) else unicodedata.normalize("NFKC", c) for c in t))


@F.pandas_udf(T.StringType())
def nfkc_keep_enclosed(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC of everything but circled marks, which tell items apart."""
    for s in values:
        yield s.map(_keep_enclosed)


@F.arrow_udf(T.ArrayType(T.StringType()))
def nfkc_keep_enclosed_each(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``nfkc_keep_enclosed`` of every text of an array; null stays null."""
    for a in values:
        lengths = [n or 0 for n in a.value_lengths().to_pylist()]
        ends = pa.array([0, *itertools.accumulate(lengths)], pa.int32())
        yield pa.ListArray.from_arrays(ends, pa.array(map(_keep_enclosed, a.flatten().to_pylist()), pa.string()), mask=a.is_null())


# Full-width forms of ASCII, the ideographic space, and units in one character; NFKC maps them alike.
FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000￥"
HALF_WIDTH = "".join(chr(0x21 + i) for i in range(94)) + " ¥"
SQUARED_UNITS = {"㎜": "mm", "㎝": "cm", "㎞": "km", "㎏": "kg", "㎎": "mg", "㎡": "m2", "㎥": "m3", "㏄": "cc", "℃": "°C", "㍉": "ミリ", "㌔": "キロ", "㌢": "センチ"}


def narrow(c: Column | str) -> Column:
    """Full-width ASCII as ASCII: what numbers, dates and marks need of NFKC, without a Python worker."""
    return F.translate(_c(c), FULL_WIDTH, HALF_WIDTH)


def plain_units(c: Column | str) -> Column:
    """Units written in one character, spelled out."""
    out = _c(c)
    for one, spelled in SQUARED_UNITS.items():
        out = F.replace(out, F.lit(one), F.lit(spelled))
    return out


def trim_spaces(c: Column | str) -> Column:
    """Strip white space of any script from both ends."""
    return F.regexp_replace(_c(c), "(?U)^\\s+|\\s+$", "")


def strip_invisible(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), INVISIBLE, "")


def clean_text(c: Column | str) -> Column:
    """Line ends to LF; control and invisible characters removed; ends stripped."""
    lines = F.regexp_replace(F.regexp_replace(_c(c), "_x000D_", ""), "\\r\\n?", "\n")
    return trim_spaces(strip_invisible(F.regexp_replace(lines, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")))


def one_line(c: Column | str) -> Column:
    return trim_spaces(F.regexp_replace(_c(c), "(?U)\\s+", " "))


def short(c: Column | str, n: int = 30) -> Column:
    """Cut to n characters, the last one an ellipsis."""
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n - 1), F.lit("…"))).otherwise(_c(c))


def is_ditto(c: Column | str) -> Column:
    # one pattern, of the marks as they are and in full width
    marks = "|".join(m.replace("\"", "[\"＂]").replace("'", "['＇]") for m in DITTO_MARKS)
    return F.coalesce(_c(c).rlike(f"(?U)^\\s*(?:{marks})\\s*$"), F.lit(False))


def is_na(c: Column | str) -> Column:
    return F.lower(F.coalesce(trim_spaces(narrow(c)), F.lit(""))).isin(NA_TOKENS)


def is_excel_error(c: Column | str) -> Column:
    return F.upper(F.coalesce(trim_spaces(narrow(c)), F.lit(""))).isin(EXCEL_ERRORS)


def estimate_tokens(c: Column | str) -> Column:
    """Token estimate in thirtieths: 33 for a non-ASCII character, 30 for a mark and a run of digits, 10 for a digit, else 15."""
    text = F.coalesce(_c(c), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    digits, runs, marks = count("[0-9]"), count("[0-9]+"), count("[!-/:-@\\[-`{-~]")
    wide = F.length(text) - F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", ""))
    other = F.length(text) - wide - digits - marks
    return F.floor((wide * 33 + other * 15 + marks * 30 + digits * 10 + runs * 30 + 29) / 30).cast("bigint")


def value_kind(c: Column | str) -> Column:
    """Kind of a cell's text, most special first."""
    t = trim_spaces(narrow(c))
    kinds = [
        (F.coalesce(t, F.lit("")) == "", "blank"),
        (F.upper(t).isin("TRUE", "FALSE"), "bool"),
        (is_excel_error(t), "error"),
        (t.rlike("^[12][0-9]{3}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), "datetime"),
        (t.rlike("^[12][0-9]{3}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?$") | t.rlike("^(19|20|21)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$"), "date"),
        (t.rlike("^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])$"), "date"),
        (t.rlike("^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), "time"),
        (t.rlike("^0[0-9]+$"), "code"),
        (t.rlike("^[-+−△▲]?(([0-9]{1,3}(,[0-9]{3})+)|[0-9]+)(\\.[0-9]+)?([eE][-+]?[0-9]+)?%?$"), "number"),
        (t.rlike("[0-9]") & t.rlike("^[A-Za-z0-9][A-Za-z0-9_./#-]{0,39}$"), "code"),
        ((F.length(t) > 40) | t.contains("\n"), "text"),
    ]
    out = F.when(*[kinds[0][0], F.lit(kinds[0][1])])
    for test, kind in kinds[1:]:
        out = out.when(test, F.lit(kind))
    return out.otherwise("string")


def escape_md_line(c: Column | str) -> Column:
    """A backslash before what Markdown would read as heading, list, quote, fence, rule or table."""
    t = _c(c)
    t = F.regexp_replace(t, "^(\\s{0,3})(#{1,6}(?:\\s|$)|[-*+](?:\\s|$)|>|```|~~~|\\|)", "$1\\\\$2")
    t = F.regexp_replace(t, "^(\\s{0,3}[0-9]{1,9})([.)](?:\\s|$))", "$1\\\\$2")
    return F.regexp_replace(t, "^(\\s{0,3})([-*_=](?:\\s*[-*_=])+\\s*)$", "$1\\\\$2")


def escape_md_text(c: Column | str) -> Column:
    """Every line of a text by ``escape_md_line``."""
    return F.array_join(F.transform(F.split(_c(c), "\n"), escape_md_line), "\n")


def md_bullet(label: Column | str, value: Column | str) -> Column:
    """``- label: value``; further lines are indented; a blank value gives an empty text."""
    text = F.coalesce(_c(value), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    many = F.concat(F.lit("- "), _c(label), F.lit(":\n  "), F.array_join(F.transform(lines, escape_md_line), "\n  "))
    one = F.concat(F.lit("- "), _c(label), F.lit(": "), F.array_join(lines, ""))
    return F.when(F.size(lines) == 0, F.lit("")).when(F.size(lines) == 1, one).otherwise(many)


def join_blocks(blocks: Column | str) -> Column:
    """Blocks without blank lines inside, one blank line between, a line feed at the end."""
    tidy = F.transform(_c(blocks), lambda b: F.trim(F.regexp_replace(b, "\\n\\s*\\n+", "\n")))
    return F.concat(F.array_join(F.filter(tidy, lambda b: b != ""), "\n\n"), F.lit("\n"))


def guard_formula(c: Column | str) -> Column:
    """An apostrophe before text that a spreadsheet would run."""
    return F.when(_c(c).rlike("^[=+\\-@\\t\\r＝＋－＠]"), F.concat(F.lit("'"), _c(c))).otherwise(_c(c))


def safe_file_part(c: Column | str, limit: int = 60) -> Column:
    """A file-name part: unsafe characters to one underscore, ends stripped, reserved names marked."""
    t = F.regexp_replace(narrow(c), "[.\\[\\]]", "")
    t = F.regexp_replace(t, "[\\x00-\\x1F<>:\"/\\\\|?*#^\\s]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^[._]+|[._]+$", "")
    t = F.regexp_replace(F.substring(t, 1, limit), "[._]+$", "")
    return F.when(F.upper(t).isin(RESERVED_NAMES), F.concat(t, F.lit("_"))).otherwise(t)


def md_filename(*parts: Column) -> Column:
    name = F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "_")
    return F.when(name == "", F.lit("無題.md")).otherwise(F.concat(name, F.lit(".md")))


def normalize_label(c: Column | str) -> Column:
    """A label for comparison: no white space, no paired marks around it, lower case."""
    t = F.regexp_replace(narrow(c), "(?U)\\s+", "")
    t = F.regexp_replace(t, "^[\\[\\](){}<>【】「」『』（）〔〕■●◆○★※・:：*]+|[\\[\\](){}<>【】「」『』（）〔〕■●◆○★※・:：*]+$", "")
    return F.lower(t)


def split_header_unit(header: Column | str, units: list[str]) -> Column:
    """Struct (name, unit) of ``name(unit)`` when the unit is a known one."""
    pattern = "^(.+?)[(（\\[［]([^()（）\\[\\]［］]{1,8})[)）\\]］]$"
    name, unit = F.regexp_extract(_c(header), pattern, 1), F.regexp_extract(_c(header), pattern, 2)
    known = unit.isin(units)
    return F.struct(
        F.when(known, trim_spaces(name)).otherwise(_c(header)).alias("name"), F.when(known, unit).otherwise(F.lit("")).alias("unit")
    )


def is_month_label(c: Column | str) -> Column:
    return trim_spaces(c).rlike("^(([12][0-9]{3}[-/.年])?(0?[1-9]|1[0-2])月(度|分)?|[12][0-9]{3}[-/.](0?[1-9]|1[0-2])|[12][0-9]{3}(0[1-9]|1[0-2])|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?)$")


# Notes in brackets behind a code that are no name.
CODE_NOTES = ["推定", "仮", "予定", "調査中", "不明", "未定", "確認中", "暫定", "候補", "要確認", "代替", "予備", "旧", "新"]


def split_entity_code(c: Column | str) -> Column:
    """Struct (code, name) of ``name(CODE)``, ``CODE(name)`` or ``CODE name``; a code has a letter and a digit.

    A note in the brackets is no name; a name of codes only is none either. What does not split is (text, ""), also null.
    """
    t = one_line(F.coalesce(_c(c), F.lit("")))
    code = "(?=[A-Za-z0-9_#./-]*[A-Za-z])(?=[A-Za-z0-9_#./-]*[0-9])[A-Za-z0-9][A-Za-z0-9_#./-]*"
    shapes = [(f"^(.+?)[ 　]*[(（]({code})[)）]$", 2, 1), (f"^({code})[(（](.+)[)）]$", 1, 2), (f"^({code})[ 　:：]+(.+)$", 1, 2)]
    out = F.struct(t.alias("code"), F.lit("").alias("name"))
    for pattern, at, other in reversed(shapes):
        found, name = F.regexp_extract(t, pattern, at), F.trim(F.regexp_extract(t, pattern, other))
        only_codes = F.forall(F.filter(F.split(name, "[\\s,、/]+"), lambda x: x != ""), lambda x: x.rlike(f"^{code}$"))
        bracketed = pattern.endswith("[)）]$") and at == 1
        named = F.struct(found.alias("code"), name.alias("name"))
        if bracketed:
            out = F.when((found != "") & name.isin(CODE_NOTES), F.struct(found.alias("code"), F.lit("").alias("name"))).when((found != "") & (name != "") & ~only_codes, named).otherwise(out)
        else:
            out = F.when((found != "") & (name != "") & ~only_codes, named).otherwise(out)
    return out


def escape_data(c: Column | str) -> Column:
    return F.translate(_c(c), "<>", "＜＞")


# --- masking and marks of log texts

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
PHONE = "\\+?[0-9]{2,4}[- ][0-9]{2,4}[- ][0-9]{3,4}"
AMOUNT = "[¥￥][0-9][0-9,]*|[0-9][0-9,]*円"


def mask_text(c: Column | str, names: list[str] | None = None) -> Column:
    """E-mail, phone, amounts and given names by fixed tokens, in this order."""
    t = F.regexp_replace(_c(c), EMAIL, "［メール］")
    t = F.regexp_replace(F.regexp_replace(t, PHONE, "［電話番号］"), AMOUNT, "［金額］")
    for name in sorted(names or [], key=len, reverse=True):
        t = F.replace(t, F.lit(name), F.lit("［人名］"))
    return t


def identifiers(c: Column | str) -> Column:
    """Distinct tokens that hold a letter and a digit, in order."""
    found = F.regexp_extract_all(_c(c), F.lit("([A-Za-z0-9][A-Za-z0-9_-]*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]")))


def numbers_in(c: Column | str) -> Column:
    """Distinct numbers of a text, thousands commas removed."""
    found = F.regexp_extract_all(_c(c), F.lit("([0-9][0-9,]*(?:\\.[0-9]+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "")))


def apply_glossary(c: Column | str, glossary: dict[str, str]) -> Column:
    """Replace terms, longest first, in one pass: what was put in is not looked at again.

    A term that starts or ends in an ASCII letter or digit is not found inside a longer word or number.
    """
    if not glossary:
        return _c(c)
    edge = "[A-Za-z0-9]"

    def bounded(term: str) -> str:
        word = lambda x: x.isascii() and x.isalnum()
        quoted = "".join(x if word(x) or not x.isascii() else f"\\{x}" for x in term)
        return f"{f'(?<!{edge})' if word(term[0]) else ''}{quoted}{f'(?!{edge})' if word(term[-1]) else ''}"

    pattern = "|".join(bounded(t) for t in sorted(glossary, key=lambda k: (-len(k), k)))
    table = F.create_map(*[F.lit(x) for pair in glossary.items() for x in pair])
    between, found = F.split(_c(c), pattern, -1), F.regexp_extract_all(_c(c), F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(between, found, lambda text, term: F.concat(F.coalesce(text, F.lit("")), F.coalesce(table[term], F.lit(""))))
    return F.when(F.size(found) == 0, _c(c)).otherwise(F.array_join(pairs, ""))
