"""Batch checks: wide aggregates and small grouped reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.functions.text import is_excel_error, is_na, value_kind

WARN_RATE, BLOCK_RATE = 0.02, 0.10


def type_errors(df: DataFrame, text: str, converted: Column, by: list[str]) -> DataFrame:
    """Checked cells, failed cells, rate and level; blanks, NA tokens and spreadsheet errors are not checked."""
    checked = ~is_na(text) & ~is_excel_error(text)
    rate = F.round(F.col("n_errors") / F.col("n_checked"), 6)
    return (
        df.groupBy(*by)
        .agg(F.count_if(checked).alias("n_checked"), F.count_if(checked & converted.isNull()).alias("n_errors"))
        .withColumn("error_rate", F.when(F.col("n_checked") > 0, rate).otherwise(0.0))
        .withColumn("level", F.when(F.col("error_rate") > BLOCK_RATE, "error").when(F.col("error_rate") >= WARN_RATE, "warning").otherwise("ok"))
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_allowed(df: DataFrame, column: str, allowed: list[str], top: int = 8) -> DataFrame:
    """The most frequent values outside the allowed ones; ties by value."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def year_outliers(df: DataFrame, year: Column, limit: int = 5) -> DataFrame:
    """Rows whose year is more than ``limit`` off the upper median; none for fewer than three rows."""
    years = df.groupBy(year.alias("y")).agg(F.count(F.lit(1)).alias("n"))  # few rows: one a year
    running = F.sum("n").over(W.orderBy("y"))
    place = years.withColumn("upto", running).crossJoin(F.broadcast(years.agg(F.sum("n").alias("total"))))
    middle = place.where(F.col("upto") > F.expr("total div 2")).agg(F.min("y").alias("middle"), F.max("total").alias("total"))
    return df.withColumn("y", year).crossJoin(F.broadcast(middle)).where((F.col("total") >= 3) & (F.abs(F.col("y") - F.col("middle")) > limit))


def kind_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, n) of several text columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), value_kind(c).alias("kind")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").groupBy("column_name", "kind").agg(F.count(F.lit(1)).alias("n"))


def infer_types(profile: DataFrame) -> DataFrame:
    """Type of each column from its kinds: text or date or number by a fifth of the filled cells, else the commonest."""
    share = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) / F.sum(F.when(F.col("kind") != "blank", F.col("n")).otherwise(0))
    top = F.max_by(F.col("kind"), F.when(F.col("kind") == "blank", F.lit(-1)).otherwise(F.col("n")))
    rules = [(share("text") >= 0.2, "text"), (share("datetime") >= 0.2, "datetime"), (share("date") >= 0.5, "date"), ((share("number") >= 0.5) & (share("code") < 0.2), "number"), (share("code") >= 0.2, "code")]
    kind = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1]))).otherwise(top)
    return profile.groupBy("column_name").agg(kind.alias("inferred_type"))


def enum_candidates(df: DataFrame, columns: list[str], least: int = 20, most: int = 12, share: float = 0.2) -> DataFrame:
    """Columns with at least ``least`` filled rows, at most ``most`` values and at most ``share`` values a row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy("column_name")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"))
        .where((F.col("n_rows") >= least) & (F.col("n_values") <= most) & (F.col("n_values") <= share * F.col("n_rows")))
    )


def rough_chars(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rough size of the rendered records: 60 a record, and for each filled value its length and 12."""
    one = sum((F.when(F.col(c).cast("string") != "", F.length(F.col(c).cast("string")) + 12).otherwise(0) for c in columns), F.lit(60))
    return df.groupBy(*by).agg(F.sum(one.cast("long")).alias("rough_chars"))


def long_values(df: DataFrame, column: str, row: str, by: list[str], limit: int = 60, shown: int = 5) -> DataFrame:
    """(by, n_long, first_rows): how many values are longer than ``limit``, and the first rows with one. Null groups are left out."""
    long = df.where(F.length(column) > limit).select(*by, row)
    # the rank's limit is applied before the shuffle too
    first = long.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(row))).where(F.col("place") <= shown)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("first_rows"))
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n_long")).join(first, by)
