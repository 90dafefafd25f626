"""Goldens of the scalar functions."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabletext.functions import text, values
from tabletext.operators import documents


def one(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_value_kind(spark):
    cells = ["20260901", "9/1", "12:30", "1,234", "△5", "007", "AB-12", "#N/A", "x" * 41, "", None, "TRUE", "2026/9/1 10:05", "東京"]
    kinds = ["date", "date", "time", "number", "number", "code", "code", "error", "text", "blank", "blank", "bool", "datetime", "string"]
    assert one(spark, text.value_kind, *cells) == kinds


def test_numbers(spark):
    cells = ["△1,000", "(1,000円)", "5-", "1e3", "1e999", "abc", None, "¥1,200", "12.5kg", "(5"]
    assert one(spark, values.parse_number, *cells) == [-1000.0, -1000.0, -5.0, 1000.0, None, None, None, 1200.0, 12.5, None]
    assert one(spark, values.duration_minutes, "1:30", "1時間30分", "x", "") == [90.0, 90.0, None, None]
    assert one(spark, lambda c: values.unit_factor(c, F.lit("分")), "h", "kg", "分", "") == [60.0, None, 1.0, 1.0]


def test_dates(spark):
    cells = ["2026/9/1(火) 10:05", "R8.4.1", "令和元年5月1日", "20260901 1005", "2026/13/1", "4/1"]
    out = one(spark, values.parse_date, *cells)
    day = datetime.date
    assert [r["date"] for r in out] == [day(2026, 9, 1), day(2026, 4, 1), day(2019, 5, 1), day(2026, 9, 1), None, None]
    assert [r["time"] for r in out] == ["10:05", None, None, "10:05", None, None]
    assert out[-1]["year_missing"]
    fiscal = one(spark, lambda c: values.parse_date(c, fiscal_year=2026), "4/1", "3/31")
    assert [r["date"] for r in fiscal] == [day(2026, 4, 1), day(2027, 3, 31)] and all(r["year_inferred"] for r in fiscal)
    assert one(spark, values.month_only, "2025年4月", "202504", "250401") == ["2025-04", "2025-04", None]
    serials = spark.createDataFrame([(46000.0,), (2999.0,), (None,)], "s double")
    assert [r["d"] for r in serials.select(values.excel_serial_date("s").alias("d")).collect()] == [day(2025, 12, 9), None, None]


def test_texts(spark):
    assert one(spark, text.escape_md_line, "# a", "1. a", "---", "plain", "- x") == ["\\# a", "1\\. a", "\\---", "plain", "\\- x"]
    assert one(spark, text.guard_formula, "=1", "＋1", "5", None) == ["'=1", "'＋1", "5", None]
    assert one(spark, text.safe_file_part, "a/b:c", "CON", "..x..") == ["a_b_c", "CON_", "x"]
    assert one(spark, text.mask_text, "03-1234-5678", "a@b.co") == ["［電話番号］", "［メール］"]
    assert [tuple(r) for r in one(spark, text.split_entity_code, "IMP-602(x)", "B2 立体駐車場（PK-801）", "ETC-302", "車")] == [("IMP-602", "x"), ("PK-801", "B2 立体駐車場"), ("ETC-302", ""), ("車", "")]
    assert [tuple(r) for r in one(spark, lambda c: text.split_header_unit(c, ["分"]), "停止時間(分)", "発生原因（推定）")] == [("停止時間", "分"), ("発生原因（推定）", "")]
    assert one(spark, text.estimate_tokens, "", "2023-09-01 09:44", None) == [0, 13, 0]
    assert one(spark, lambda c: text.nfkc(c), "ｱＡ１", None) == ["アA1", None]
    assert one(spark, lambda c: text.nfkc_keep_enclosed(c), "①Ａ") == ["①A"]
    assert one(spark, text.clean_text, " a\r\nb\u200b_x000D_\x07 ") == ["a\nb"]
    assert one(spark, lambda c: text.apply_glossary(c, {"ab": "b", "b": "c"}), "ab b") == ["b c"]
    assert one(spark, lambda c: values.format_number(c.cast("double")), "1234.5", "1234", "0.125") == ["1,234.5", "1,234", "0.13"]


def plain_tokens(t):
    import re

    digits, runs = len(re.findall("[0-9]", t)), len(re.findall("[0-9]+", t))
    marks, wide = len(re.findall("[!-/:-@\\[-`{-~]", t)), sum(ord(c) > 127 for c in t)
    return -(-(33 * wide + 10 * digits + 30 * runs + 30 * marks + 15 * (len(t) - wide - digits - marks)) // 30)


def test_full_width_forms(spark):
    assert one(spark, values.parse_number, "１２３", "△１，０００", "（１，０００円）", "￥１，２００", "１２．５ｋｇ") == [123.0, -1000.0, -1000.0, 1200.0, 12.5]
    day = datetime.date
    assert [r["date"] for r in one(spark, values.parse_date, "２０２６/９/１", "２０２６年９月１日（火）", "Ｒ８．４．１", "２０２６０９０１")] == [day(2026, 9, 1), day(2026, 9, 1), day(2026, 4, 1), day(2026, 9, 1)]
    assert one(spark, values.time_of_day, "９：０５") == ["09:05"] and one(spark, values.duration_minutes, "１時間３０分") == [90.0]
    assert one(spark, values.month_only, "２０２５年４月") == ["2025-04"]
    assert one(spark, text.value_kind, "１２３", "２０２６/９/１", "＃Ｎ／Ａ", "ＡＢ－１２") == ["number", "date", "error", "code"]
    assert one(spark, text.is_ditto, "＂", "〃", "x") == [True, True, False] and one(spark, text.is_na, "－", "Ｎ／Ａ") == [True, True]
    assert one(spark, text.normalize_label, "［ＮＯ．］") == ["no."] and one(spark, text.safe_file_part, "Ａ／Ｂ") == ["A_B"]
    assert one(spark, values.normalize_unit, "㎜", "ｍｉｎ") == ["mm", "分"]


def test_codes_and_terms(spark):
    cells = ["IMP-602（推定）", "VH-203 / VH-204", "KJ-118 新橋支店 改装工事", None, "A-1(B-2)"]
    assert [tuple(r) for r in one(spark, text.split_entity_code, *cells)] == [("IMP-602", ""), ("VH-203 / VH-204", ""), ("KJ-118", "新橋支店 改装工事"), ("", ""), ("A-1(B-2)", "")]
    terms = {"the": "THE", "then": "T", "送風機": "ファン", "a.b": "x", "THE": "y"}
    cells = ["the other then THE", "送風機の送風機", "a.b aab xa.b", "", None, "the"]
    assert one(spark, lambda c: text.apply_glossary(c, terms), *cells) == ["THE other T y", "ファンのファン", "x aab xa.b", "", None, "THE"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 。、,.!？1２漢\n"), max_size=400), st.integers(3, 40))
def test_pieces_join_to_the_text(t, budget):
    pieces = documents.text_pieces(t, budget)
    assert "".join(pieces) == t
    assert all(plain_tokens(p) <= budget or len(p) < 2 for p in pieces)


def test_month_labels(spark):
    assert one(spark, text.is_month_label, "4月", "2025年4月度", "202504", "Apr", "x") == [True, True, True, True, False]
    assert one(spark, lambda c: text.md_bullet(F.lit("k"), c), "v", "", "a\n# b") == ["- k: v", "", "- k:\n  a\n  \\# b"]


@pytest.mark.parametrize("size,limit,parts", [(10, 35, 3), (10, 1000, 1)])
def test_part_sizes(spark, size, limit, parts):
    rows = spark.range(10).select(F.lit("g").alias("g"), "id", F.lit(size).alias("n"))
    out = documents.part_sizes(rows, ["g"], ["id"], "n", limit).collect()
    assert {r["parts"] for r in out} == {parts} and sorted({r["part"] for r in out}) == list(range(1, parts + 1))
