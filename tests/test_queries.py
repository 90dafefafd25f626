"""Every query of the record operators against its DuckDB statement, on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__
from tabletext.operators import documents
from tabletext.plans import file_queries, record_queries, table_queries

SF = "/root/testdata/sf0.001"
QUERIES = table_queries.QUERIES | record_queries.QUERIES | file_queries.QUERIES
ORACLES = table_queries.ORACLES | record_queries.ORACLES | file_queries.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(norm(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["fill_down", "record_keys", "ditto_fill", "blank_runs", "size_split_files"])
def test_results_do_not_depend_on_partitions(spark, name, monkeypatch):
    """The same rows come out when the input is dealt out anew."""
    first = sorted(map(repr, table_queries.QUERIES[name](spark, SF).collect()))
    whole = table_queries.table
    monkeypatch.setattr(table_queries, "table", lambda s, d, t: whole(s, d, t).repartition(7))
    assert sorted(map(repr, table_queries.QUERIES[name](spark, SF).collect())) == first


def test_every_order_has_a_position(spark):
    n = table_queries.table(spark, SF, "orders").count()
    got = table_queries.QUERIES["sort_dated_all"](spark, SF).collect()
    assert sorted(r["position"] for r in got) == list(range(1, n + 1))
    undated = {r["position"] for r in got if r["o_orderkey"] % 7 == 0}
    assert undated == set(range(n - len(undated) + 1, n + 1)) and len(undated) > 0


def test_positions_with_nulls_ties_and_few_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 5) for i in range(500)], "k long, d int")
    for few in (rows, rows.limit(1), rows.limit(0)):
        got = documents.positions(few, documents.dated_first("d", "k"), ranges=7).collect()
        want = sorted(((r["d"] is None, r["d"] or 0, r["k"]) for r in few.collect()))
        assert [r["k"] for r in sorted(got, key=lambda r: r["position"])] == [k for *_, k in want]


def test_every_line_of_a_text_is_escaped(spark, monkeypatch):
    texts = ["plain\n# head\n- item\n\n1. one\n---\n  > quote\nend #", "", None, "\n\n", "* a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(table_queries, "table", lambda s, d, t: docs)
    got = {r["doc_id"]: r["escaped"] for r in table_queries.QUERIES["markdown_escape_text"](spark, SF).collect()}
    assert got == {0: "plain\n\\# head\n\\- item\n\n1\\. one\n\\---\n  \\> quote\nend #", 1: "", 2: "", 3: "\n\n", 4: "\\* a"}
