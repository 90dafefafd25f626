"""Row-to-record operators and enrichment joins on small frames."""

import pytest
from pyspark.sql import functions as F

from tabletext import session
from tabletext.operators import checks, documents, enrich, records


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_ditto_and_fill_down(spark):
    rows = [("s", 1, "〃"), ("s", 2, "〃"), ("s", 3, "A"), ("s", 4, "同上"), ("s", 5, ""), ("s", 6, '"'), ("t", 1, "B"), ("t", 2, "々")]
    df = frame(spark, rows, "s string, r int, v string")
    out = {(r["s"], r["r"]): r["f"] for r in records.ditto_fill(df, "v", ["s"], ["r"], "f").collect()}
    # a mark without a value above stays; a mark below a blank takes the blank
    assert out == {("s", 1): "〃", ("s", 2): "〃", ("s", 3): "A", ("s", 4): "A", ("s", 5): "", ("s", 6): "", ("t", 1): "B", ("t", 2): "B"}
    out = {(r["s"], r["r"]): r["f"] for r in records.fill_down(df, "v", ["s"], ["r"], "f").collect()}
    assert out["s", 5] == "同上" and out["t", 1] == "B"


def test_keys(spark):
    df = frame(spark, [(1, "A", "1", ""), (2, "A", "1", ""), (3, "A", "", "F"), (4, "", None, ""), (5, "A", "1", "")], "r int, a string, b string, c string")
    out = [r["record_key"] for r in records.record_keys(df, ["a", "b"], ["r"], ["c"]).orderBy("r").collect()]
    assert out == ["A|1", "A|1#2", "F", "行4", "A|1#3"]
    assert df.select(records.key_prefix(F.lit("ab　c d"), 3).alias("p")).first()["p"] == "abc"


def test_merged_cells(spark):
    cells = [(1, 3, 0, "head", None, None), (1, 5, 0, "x", 5, 0), (1, 6, 0, "", 5, 0), (1, 6, 1, None, 3, 1), (1, 7, 0, "own", 5, 0)]
    df = frame(spark, cells, "s int, row int, col int, text string, anchor_row int, anchor_col int")
    out = {(r["row"], r["col"]): r["text"] for r in records.expand_merged(df, ["s"], 5).collect()}
    assert out == {(3, 0): "head", (5, 0): "x", (6, 0): "x", (6, 1): None, (7, 0): "own"}


def test_reconcile(spark):
    rows = [(1, 1, 10.0, False), (1, 2, 5.0, False), (1, 3, 15.0, True), (1, 4, 7.0, False), (1, 5, 8.0, True), (1, 6, 22.0, True)]
    out = records.reconcile(frame(spark, rows, "s int, r int, v double, sub boolean"), "v", F.col("sub"), ["s"], ["r"]).orderBy("r").collect()
    assert [(r["running_sum"], r["grand_sum"], r["difference"]) for r in out] == [(15.0, 15.0, 0.0), (7.0, 22.0, 1.0), (0.0, 22.0, 22.0)]


def test_continuations_and_links(spark):
    rows = [(1, 1, "a", True), (1, 2, "b", False), (1, 3, "c", True), (2, 1, "x", False)]
    out = records.merge_continuations(frame(spark, rows, "s int, r int, t string, starts boolean"), F.col("starts"), "t", ["s"], ["r"]).collect()
    assert {(r["s"], r["record_no"], r["t"], r["n_rows"]) for r in out} == {(1, 1, "a\nb", 2), (1, 2, "c", 1), (2, 0, "x", 1)}
    df = frame(spark, [("a", "u"), ("see u", "u"), ("", "u"), ("a", None)], "t string, l string")
    assert {r["v"] for r in df.select(records.append_link("t", "l").alias("v")).collect()} == {"a（u）", "see u", "u", "a"}


def test_checks(spark):
    df = frame(spark, [("x", "1"), ("x", "二"), ("x", "-"), ("x", "#N/A"), ("y", "3")], "g string, t string")
    out = {r["g"]: (r["n_checked"], r["n_errors"], r["level"]) for r in checks.type_errors(df, "t", F.col("t").try_cast("double"), ["g"]).collect()}
    assert out == {"x": (2, 1, "error"), "y": (1, 0, "ok")}
    years = frame(spark, [(y,) for y in (2020, 2021, 2021, 2035)], "y0 int")
    assert [r["y"] for r in checks.year_outliers(years, F.col("y0")).collect()] == [2035]
    assert checks.year_outliers(years.limit(2), F.col("y0")).count() == 0


def test_names_and_titles(spark):
    df = frame(spark, [(1, "A.md"), (2, "a.md"), (3, "b.md"), (4, "A.md")], "i int, n string")
    assert [r["unique_name"] for r in documents.unique_names(df, "n", ["i"]).orderBy("i").collect()] == ["A.md", "a_2.md", "b.md", "A_3.md"]
    out = documents.title_suffixes(df.withColumn("g", F.lit(1)), "n", ["g"], "i", "t").orderBy("i").collect()
    assert [r["t"] for r in out] == ["A.md（1行目）", "a.md", "b.md", "A.md（4行目）"]


def test_enrichment(spark):
    works = frame(spark, [(1, "k"), (2, "k"), (3, "m")], "i int, key string")
    assert {(r["key"], r["n_rows"]) for r in enrich.one_request_each(works, "key").collect()} == {("k", 2), ("m", 1)}
    cache = frame(spark, [("k", "old")], "key string, answer string")
    assert [r["i"] for r in enrich.missing(works, cache, "key").collect()] == [3]
    assert enrich.fan_out(works, cache, "key").count() == 2
    new = frame(spark, [("k", "new"), ("z", "z")], "key string, answer string")
    assert {tuple(r) for r in enrich.upsert(cache, new, ["key"]).collect()} == {("k", "new"), ("z", "z")}
    rule = {"any": [{"min_segments": 3}, {"all": [{"contains": ["x", "y"]}, {"min_chars": 2}]}]}
    df = frame(spark, [(1, "ax"), (4, ""), (1, "b")], "n int, t string")
    assert sorted(r["n"] for r in df.where(enrich.run_if(rule, F.col("n"), F.col("t"))).collect()) == [1, 4]
    with pytest.raises(ValueError):
        enrich.run_if({"other": 1}, F.col("n"), F.col("t"))
    assert enrich.stable_json({"b": 1, "a": "あ"}) == '{"a":"あ","b":1}'


def test_tables_of_texts_come_in_bounded_batches(spark):
    """At Spark's defaults a Python worker would hold 10,000 whole texts; limits set by hand stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for given, held in (("10000", "1000"), ("37", "37")):
            spark.conf.set(rows, given)
            session.table(spark, "/root/testdata/sf0.001", "documents")
            assert spark.conf.get(rows) == held
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
