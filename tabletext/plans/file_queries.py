"""Queries that write given tables as files of people (encodings, dialects, several tables in a file) and import them again."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.plans.import_plan import Imported, read_records
from tabletext.session import scratch_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of a file, about: it is read by one task, and more orders make more files.
FILE_ROWS = 100_000

ENCODINGS = ["utf-8", "cp932", "euc_jp", "utf-16le"]
DELIMITERS = [",", "\t", ";", ","]


def query(name: str, oracle: str) -> Callable:
    """Register a query and the DuckDB statement it must equal."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _value(key: str) -> Column:
    v = F.element_at("values", key)
    return F.when(v != "", v)


def _spelled(encoding: str) -> Callable[[Column], Column]:
    """A text whose Latin-1 bytes are those of another in an encoding that Spark does not write."""

    @F.pandas_udf("string")
    def spell(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda t: None if t is None else t.encode(encoding).decode("latin-1"))

    return spell


def orders_as_files(spark: SparkSession, sf_dir: str) -> Imported:
    """Orders as lists in four encodings with three delimiters, days in three forms and some left out, prices with commas and units."""
    key = F.col("o_orderkey")
    day = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(key % 3 == 1, F.date_format("o_orderdate", "yyyy年M月d日")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(key % 2 == 0, F.format_number("o_totalprice", 2)).otherwise(F.concat(F.lit("￥"), F.format_number("o_totalprice", 2)))
    text = F.concat(F.lit("「確認」、\"済\"\n注文"), key.cast("string"))
    rows = table(spark, sf_dir, "orders").select(
        (key % 4).alias("way"), F.concat(F.lit("N-"), key.cast("string")).alias("管理No"), F.when(key % 11 != 0, day).otherwise("").alias("発生日"),
        price.alias("金額(円)"), F.col("o_orderstatus").alias("状態"), text.alias("現象"),
    )
    root = scratch_dir(spark)
    files = max(2, math.ceil(rows.count() / len(ENCODINGS) / FILE_ROWS))
    for way, (encoding, delimiter) in enumerate(zip(ENCODINGS, DELIMITERS, strict=True)):
        part = rows.where(F.col("way") == way).drop("way").repartition(files, "管理No")
        if not encoding.startswith("utf"):
            part = part.select(*[_spelled(encoding)(F.col(c)).alias(c.encode(encoding).decode("latin-1")) for c in part.columns])
            encoding = "iso-8859-1"
        part.write.option("header", True).option("encoding", encoding).option("sep", delimiter).option("escape", '"').csv(f"{root}/{way}")
    return read_records(spark, f"{root}/*/*.csv")


@query(
    "import_orders",
    """SELECT 'N-' || o_orderkey::VARCHAR AS record_key, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
      round(o_totalprice, 2) AS price, o_orderstatus AS status, '「確認」、"済"' || chr(10) || '注文' || o_orderkey::VARCHAR AS note FROM orders""",
)
def import_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order out of files in four encodings: headers, types, days, numbers and quoted line ends are found."""
    got = orders_as_files(spark, sf_dir)
    key = {r["header"]: r["key"] for r in got.columns.select("header", "key").distinct().limit(50).collect()}
    price = next(k for h, k in key.items() if h.startswith("金額"))
    return got.records.select(
        "record_key", F.col("date_value").alias("day"), _value(price).cast("double").alias("price"), _value(key["状態"]).alias("status"), _value(key["現象"]).alias("note")
    )


@query(
    "import_issues",
    "SELECT 'undated' AS code, count(*) FILTER (o_orderkey % 11 = 0)::BIGINT AS n FROM orders HAVING count(*) FILTER (o_orderkey % 11 = 0) > 0",
)
def import_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the import of the orders finds wrong: the days left out, and nothing else."""
    issues = orders_as_files(spark, sf_dir).issues
    return issues.groupBy("code").agg(F.sum("n").alias("n"))


@query(
    "import_two_tables",
    """SELECT 1 AS place, 'C-' || c_custkey::VARCHAR AS record_key, c_mktsegment AS name, round(c_acctbal, 2) AS amount FROM customer
    UNION ALL SELECT 2, 'S-' || s_suppkey::VARCHAR, s_name, round(s_acctbal, 2) FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def import_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a nation, with its customers and, below a blank row and a title, its suppliers: two tables of one sheet."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    line = lambda *c: F.concat_ws(",", *c)
    amount = lambda c: F.format_string("%.2f", c)
    day = lambda c: F.concat(F.lit("2026/4/"), (F.col(c) % 28 + 1).cast("string"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.lit(1).alias("place"), F.col("c_custkey").cast("long").alias("k"),
        line(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")), day("c_custkey"), "c_mktsegment", amount("c_acctbal")).alias("line"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.lit(3).alias("place"), F.col("s_suppkey").cast("long").alias("k"), line(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")), "s_name", amount("s_acctbal")).alias("line")
    )
    first = nation.select("nation", F.lit(0).alias("place"), F.lit(0).cast("long").alias("k"), F.lit("管理No,発生日,区分,金額(円)").alias("line"))
    second = nation.join(suppliers.select("nation").distinct(), "nation").select("nation", F.lit(2).alias("place"), F.lit(0).cast("long").alias("k"), F.lit("\n仕入先一覧\n管理No,設備名,金額(円)").alias("line"))
    root = scratch_dir(spark)
    rows = first.unionByName(customers).unionByName(second).unionByName(suppliers)
    rows.repartition("nation").sortWithinPartitions("nation", "place", "k").select("nation", "line").write.partitionBy("nation").text(root)
    got = read_records(spark, f"{root}/*/*.txt")
    keys = {(r["sheet"], r["header"]): r["key"] for r in got.columns.select("sheet", "header", "key").distinct().limit(50).collect()}
    of = lambda sheet, head: next(k for (s, h), k in keys.items() if s == sheet and h.startswith(head))
    below = F.col("sheet") != ""
    return got.records.select(
        F.when(below, 2).otherwise(1).alias("place"), "record_key", F.when(below, _value(of("［2］", "設備名"))).otherwise(_value(of("", "区分"))).alias("name"),
        F.when(below, _value(of("［2］", "金額"))).otherwise(_value(of("", "金額"))).cast("double").alias("amount"),
    )
