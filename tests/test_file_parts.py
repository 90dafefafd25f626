"""Cuts of files by size against the rule record by record."""

import hashlib
import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from tabletext.operators import documents
from tabletext.plans import table_queries


def greedy(sizes, limit):
    parts = max(1, math.ceil(sum(sizes) / limit))
    target, out, part, held = sum(sizes) / parts, [], 1, 0
    for i, n in enumerate(sizes):
        if i and held and held + n > target and part < parts:
            part, held = part + 1, 0
        held += n
        out.append(part)
    return out, parts


def test_parts_of_many_groups(spark, monkeypatch):
    """Groups that lie within a range and over many, one of a third of all rows, rows larger than a part, ties and null keys."""
    monkeypatch.setattr(documents, "RANGE_ROWS", 150)
    rng, rows = random.Random(5), []
    for g in ["a", "b", None, *[f"g{i}" for i in range(30)]]:
        for i in range({"a": 900, "b": 300, None: 150}.get(g, rng.randrange(1, 60))):
            rows.append((g, i // 2, rng.choice([1, 5, 20, 20, 300]) + i % 2, f"{g}-{i}"))
    df = spark.createDataFrame(rows, "g string, k int, n int, name string").repartition(7)
    got = {r["name"]: (r["part"], r["parts"], r["place"]) for r in documents.part_sizes(df, ["g"], ["k", "name"], "n", 200).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3]))
        parts, n = greedy([r[2] for r in own], 200)
        assert [got[r[3]] for r in own] == [(p, n, i) for i, p in enumerate(parts, 1)], g


def test_one_part_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 10)], "g string, k int, n int")
    assert [r["part"] for r in documents.part_sizes(df, ["g"], ["k"], "n").collect()] == [1, 1]
    assert documents.part_sizes(df.where("k > 5"), ["g"], ["k"], "n").count() == 0


def test_neighbours_of_parts(spark):
    rows = spark.createDataFrame([("2026-04", i, "x" * 100) for i in range(10)], "m string, k int, b string")
    files = documents.file_groups(rows, ["m"], [F.col("k")], "b", 350).orderBy("part").collect()
    assert [(f["part"], f["parts"], f["n_records"], f["first_record"], f["last_record"]) for f in files] == [(1, 3, 3, 1, 3), (2, 3, 3, 4, 6), (3, 3, 4, 7, 10)]
    assert files[0]["text"] == "\n\n".join(["x" * 100] * 3)


def test_a_month_over_the_limit_is_told_as_one(spark, monkeypatch):
    rows = [(k, datetime(2026, 4 + k % 2, 1 + k % 28), "O" * (k % 5)) for k in range(300)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_orderstatus string").repartition(5)
    monkeypatch.setattr(table_queries, "table", lambda s, d, t: orders)
    cut = documents.file_groups
    monkeypatch.setattr(documents, "file_groups", lambda *args: cut(*args, limit=500))
    got = {r["month"]: (r["text_md5"], r["n_records"]) for r in table_queries.QUERIES["month_files"](spark, "").collect()}
    want = {}
    for month in (4, 5):
        own = [f"## 【{k}】{status}" for k, day, status in rows if day.month == month]
        want[f"2026-{month:02}"] = hashlib.md5("\n\n".join(own).encode()).hexdigest(), len(own)
    assert got == want
