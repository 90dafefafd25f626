"""Verification of answers, titles and year contexts."""

import json

import pytest
from pyspark.sql import functions as F

from tabletext.functions import titles
from tabletext.operators import enrich, verify

SEGMENTS = ["2026/4/1 ポンプ P-12 を点検、異常なし", "4/2 部品 3 個を交換予定"]


def answer(*entries):
    return "```json\n" + json.dumps({"entries": [dict(zip(("segments", "type", "text", "quote"), e, strict=False)) for e in entries]}, ensure_ascii=False) + "\n```"


CASES = [
    (answer(([1], "点検", "P-12を点検、異常なし", "異常なし"), ([2], "計画", "部品3個を交換予定")), "ok", set()),
    ("<think>x {</think>no", "error", {"json"}),
    (answer(([1], "点検", "P-12を点検、異常なし")), "error", {"coverage"}),
    (answer(([1, 1], "点検", "P-12"), ([2], "計画", "予定")), "error", {"coverage", "not_adjacent", "flip_dropped"}),
    (answer(([1], "別", "P-99を点検、異常なし"), ([2], "計画", "部品5個を交換予定")), "flagged", {"type", "identifier", "number", "identifiers_missing"}),
    (answer(([1], "点検", "P-12を4/1に点検完了、異常なし", "無い引用"), ([2], "計画", "田中が交換予定" + "あ" * 90)), "flagged", {"date", "flip_added", "quote", "name", "too_long"}),
]


@pytest.mark.parametrize("text,status,codes", CASES)
def test_verify(spark, text, status, codes):
    df = spark.createDataFrame([(text, SEGMENTS)], "a string, s array<string>")
    row = verify.verify(df, "a", "s", ["点検", "計画"], ["田中"]).select("issues", verify.verdict().alias("v")).first()
    assert (row["v"], {i["code"] for i in row["issues"]}) == (status, codes)


def test_answers_to_types_and_choices(spark):
    df = spark.createDataFrame([(CASES[0][0], " はい\n", "x" * 300)], "a string, b string, c string")
    row = df.select(verify.segment_types("a").alias("t"), verify.custom_result("b", ["はい", "いいえ"]).alias("b"), verify.custom_result("c", fallback="不明").alias("c")).first()
    assert (row["t"], row["b"], row["c"]) == ({1: "点検", 2: "計画"}, "はい", "不明")
    assert verify.estimate(100, 500, 6, 4, 10_000)["minutes"] == 5.0


def test_calls_are_injected(spark):
    df = spark.createDataFrame([("k1", "a"), ("k2", "fail")], "cache_key string, prompt string")

    def client(prompt):
        if prompt == "fail":
            raise TimeoutError("late")
        return prompt.upper()

    rows = {r["cache_key"]: (r["answer"], r["error"]) for r in enrich.call(df, client).collect()}
    assert rows == {"k1": ("A", None), "k2": (None, "late")}


def test_titles(spark):
    cases = [
        ("あいうえお", 5, "あいうえお"), ("あいうえおか", 5, "あいうえお…"), ("送風機の点検（3番・北側の建屋）", 12, "送風機の点検…"),
        ("送風機（3番）の点検（北側）の件", 13, "送風機（3番）の点検…"), ("a(b)c[d]e(f)ghij", 9, "a(b)c[d]e…"), ("a((b)cdefgh", 6, "a((b)c…"), ("一二三、四五", 4, "一二三…"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, n int, want string")
    for i, (_, n, want) in enumerate(cases):
        assert rows.where(F.col("i") == i).select(titles.clip_title("t", n).alias("x")).first()["x"] == want
    assert rows.where("i = 0").select(titles.clip_title(F.lit("（長い括弧のままで続く文章）"), 8).alias("x")).first()["x"].startswith("（長い")
    lines = spark.createDataFrame([("2026/4/1 10:00 【連絡】\n・ポンプ停止\n復旧",), ("\n",), (None,)], "t string")
    assert [r["x"] for r in lines.select(titles.title_line("t").alias("x")).collect()] == ["ポンプ停止", "", ""]
    df = spark.createDataFrame([("K-1", "ポンプ", "EQ-1", "2026/4/1 10:00 【重要】異音がした\n続き", "2026-04-01"), (None, None, None, None, None)], "k string, n string, c string, t string, d string")
    rows = [r["v"] for r in df.select(titles.record_title("k", "n", "c", "t", "d").alias("v")).collect()]
    assert rows == ["【K-1】ポンプ（EQ-1）異音がした｜2026-04-01", ""]
    plan = df.select(titles.record_title("k", "n", "c", "t", "d").alias("v"))
    assert len(plan._jdf.queryExecution().toString()) < 50_000  # arguments that an expression names often are bound once
    df = spark.createDataFrame([("eq-12a ポンプ", '#,##0"分"'), ("ポンプ", "0.0%"), ("x", "General")], "t string, f string")
    assert [tuple(r) for r in df.select(titles.upper_code("t"), titles.format_unit("f")).collect()] == [("EQ-12A ポンプ", "分"), ("ポンプ", "%"), ("x", "")]


def test_year_context():
    get = lambda *s: {k: v for k, v in titles.year_context([("f", x) for x in s]).items() if v and k != "source"}
    assert get("2026年度_x.csv") == {"fiscal_year": 2026} and get("令和８年度 実績") == {"fiscal_year": 2026}
    assert get("R8.4_x.csv") == {"year": 2026, "month": 4} and get("202604.csv") == {"year": 2026, "month": 4}
    assert get("x.csv", "2025年") == {"year": 2025} and get("x.csv") == {} and get("3026年") == {}
