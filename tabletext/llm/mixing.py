"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate so that its expected share of the output is its target weight. Each document
is then repeated k times, k being the inverse of a Poisson distribution at a number that only the document's key, the
seed and the rate fix. The copies are dealt out by a hash of key and copy, uniform in [0, 1), and
ordered by it within each part: a global shuffle that a rerun repeats exactly and that needs no sample of its keys.

Edge cases: a null source is a source of its own; a null key has the hash of the empty text; repeated rows are repeated
alike and dealt out together; an empty table gives an empty result; columns of the input named like the added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.llm.common import read, written

#: Above this mean, a draw is the sum of draws of smaller mean, so that exp(-rate) stays far from zero.
MAX_RATE = 400.0


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds ``u``."""
    limit = F.ceil(rate + 12.0 * F.sqrt(rate) + 30.0).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"), F.lit(False).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        done = acc["done"] | (u < acc["c"])
        p = acc["p"] * rate / k.cast("double")
        return F.struct(
            F.when(done, acc["p"]).otherwise(p).alias("p"),
            F.when(done, acc["c"]).otherwise(acc["c"] + p).alias("c"),
            F.when(done, acc["k"]).otherwise(k).alias("k"),
            done.alias("done"),
        )

    return F.aggregate(F.sequence(F.lit(1), limit), start, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, source: str, weights: DataFrame | None, temperature: float, size: float) -> DataFrame:
    """One row per source: rows, target weight and mean repetition rate. Without weights, rows ** (1 / temperature)."""
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_rows"))
    if weights is None:
        counts = counts.withColumn("mix_weight", F.pow(F.col("mix_rows").cast("double"), F.lit(1.0 / temperature)))
    else:
        given = weights.select(F.col("source").alias("given_source"), F.col("weight").cast("double").alias("given_weight"))
        counts = counts.join(given, F.col("mix_source").eqNullSafe(F.col("given_source")), "left").select(
            "mix_source", "mix_rows", F.coalesce("given_weight", F.lit(0.0)).alias("mix_weight")
        )
    over = lambda c: F.sum(c).over(W.partitionBy(F.lit(0)))  # noqa: E731  of one row a source
    return counts.withColumn("all_weight", over("mix_weight")).withColumn("all_rows", over("mix_rows")).select(
        "mix_source",
        "mix_rows",
        F.when(F.col("all_weight") > 0, F.col("mix_weight") / F.col("all_weight")).otherwise(0.0).alias("mix_share"),
        F.when(
            F.col("all_weight") > 0,
            F.col("mix_weight") / F.col("all_weight") * F.col("all_rows") * F.lit(float(size)) / F.col("mix_rows"),
        ).otherwise(0.0).alias("rate"),
    )


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    weights: DataFrame | None = None,
    temperature: float = 2.0,
    size: float = 1.0,
    seed: str = "mix",
    shuffle: bool = True,
) -> DataFrame:
    """Repeat documents by Poisson counts and shuffle them.

    ``weights`` (source, weight) names the targets, one row a source; sources it does not name get none. ``size`` is the
    expected output size as a multiple of the input. Adds ``copy`` (from 1), ``rate`` and ``shuffle_key`` (in [0, 1)).
    """
    kept = [c for c in docs.columns if c not in {"copy", "rate", "shuffle_key"}]
    docs = docs.select(*kept)
    # a written table has a known size: Spark broadcasts it below its limit, else joins by shuffle and splits hot sources
    rates = written(source_rates(docs, source, weights, temperature, size), "mix-rates")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE))).cast("int")
    draw = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda total, i: total
        + poisson_inverse(unit_hash(F.lit(seed), key, i.cast("string")), F.col("rate") / parts.cast("double")),
    )
    mixed = (
        docs.join(rates.select("mix_source", "rate"), F.col(source).eqNullSafe(F.col("mix_source")))
        .withColumn("mix_times", draw)
        .where("mix_times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_times"))))
        .withColumn("shuffle_key", unit_hash(F.lit(f"{seed}:order"), key, "copy"))
        .select(*kept, "copy", "rate", "shuffle_key")
    )
    if not shuffle:
        return mixed
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mixed.repartition(parts, F.floor(F.col("shuffle_key") * (1 << 20)))  # a hash of a uniform number: equal shares, no sampling pass
    return dealt.sortWithinPartitions("shuffle_key", key, "copy")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, sources at square-root weights, as many rows out as in on average."""
    docs = read(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "copy", "source", F.round("rate", 9).alias("rate"), F.round("shuffle_key", 12).alias("shuffle_key"), "text")


ORACLE = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(n::DOUBLE)) AS w, sum(n)::DOUBLE AS a FROM c),
r AS (SELECT source, sqrt(n::DOUBLE) / w * a * 1.0 / n AS rate FROM c, t),
d AS (SELECT doc_id, documents.source, text, rate,
  ('0x' || substr(md5('mix:' || doc_id::VARCHAR || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
k AS (SELECT source, rate, i, exp(-rate) * pow(rate, i) / factorial(i::INTEGER) AS p
  FROM r, generate_series(0, 18) g(i)),
f AS (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cdf FROM k),
m AS (SELECT d.doc_id, d.source, d.text, d.rate,
  (SELECT count(*) FROM f WHERE f.source IS NOT DISTINCT FROM d.source AND f.cdf <= d.u) AS times FROM d),
e AS (SELECT m.*, unnest(generate_series(1, times)) AS copy FROM m WHERE times > 0)
SELECT doc_id, copy::INTEGER AS copy, source, round(rate, 9) AS rate,
  round(('0x' || substr(md5('mix:order:' || doc_id::VARCHAR || ':' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496.0, 12) AS shuffle_key, text
FROM e
"""
