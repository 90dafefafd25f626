"""Exact top-k search by inner product, block-at-a-time.

Vectors of integers lie in blocks of near ones (those nearest the same pivot, by id); a block knows the largest and smallest
value of each component. The sum of a query's terms, each with the extreme that makes it largest, bounds every score in the
block. Blocks are taken in order of their bounds and scored whole, until the bounds fall below the query's k-th score.

Blocks lie in groups of bounded size, which have such bounds too. First each query meets the group that holds its own
neighbourhood, which gives it a k-th score to start from; the bounds of all groups, in chunks, then tell which other groups
it has to see, and only there queries and vectors are sent. The best k of all cells are ranked. Vectors that lie in clusters
are pruned so; of vectors without any structure no bound can rule out a block, and all are scored.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; a query
is compared with vectors of its own length and another id; of rows with equal id and vector one counts; ties go to the
smaller id; an empty table gives an empty result; other columns are not read. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.llm.common import read, written

SCALE = 1024
BLOCK = 128
#: Vectors in a group, about, and queries that meet a group at once.
GROUP_ROWS, QUERY_ROWS = 8192, 2048
#: Vectors, those with the smallest hashes, that the others are sorted by; a bounded sample, on which only speed depends.
PIVOTS = 256
#: Groups whose bounds are compared with a part of the queries at once.
CHUNK_GROUPS = 2048


def integer_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, dim, v): whole components as doubles, which hold them exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            bad = ~np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            odd = np.concatenate([[0], np.cumsum(bad)])
            use = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False) & (sizes > 0) & (odd[ends] == odd[ends - sizes])
            kept = batch.filter(pa.array(use))
            x = np.floor(SCALE * kept.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            if not np.isfinite(x).all():
                raise ValueError("a component is out of range")
            bounds = np.concatenate([[0], np.cumsum(sizes[use])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), pa.array(sizes[use].astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))], names=["vec_id", "dim", "v"]
            )

    return rows.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(run, "vec_id long, dim int, v array<double>")


def with_codes(vectors: DataFrame) -> DataFrame:
    """Adds ``code``, the number of the nearest pivot of a vector's length."""
    turn = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v"))
    share = min(1.0, 4 * PIVOTS / max(1, vectors.count()))
    few = F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(10**9)) < F.lit(int(share * 10**9))
    pivots: dict[int, list] = {}
    for r in vectors.where(few).withColumn("turn", turn).where(F.col("turn") <= PIVOTS).orderBy("dim", "turn").limit(4 * PIVOTS).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    tables = {}
    for dim, listed in pivots.items():
        p = np.array(listed)
        p = p[np.argsort(p @ p[0], kind="stable")]  # near pivots get near numbers
        tables[dim] = p, (p * p).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            codes = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in tables:
                    p, norms = tables[dim]
                    x = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    codes[at] = np.argmax(2 * x @ p.T - norms, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["vec_id", "dim", "v", "code"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v array<double>, code int")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's best k in one group; what is below ``least`` may be left out."""
    if not len(ids) or not len(query_ids):
        return []
    if float(np.abs(vectors).max()) * float(np.abs(queries).max()) * vectors.shape[1] >= 2.0**53:  # beyond exact doubles
        vectors = np.array([[int(x) for x in row] for row in vectors.tolist()], object)
        queries = np.array([[int(x) for x in row] for row in queries.tolist()], object)
    cuts = np.arange(0, len(ids), BLOCK)
    top, low = np.maximum.reduceat(vectors, cuts, axis=0), np.minimum.reduceat(vectors, cuts, axis=0)
    plus = np.where(queries > 0, queries, queries * 0)
    bounds = plus @ top.T + (queries - plus) @ low.T
    out = []
    for q, bound in enumerate(bounds):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
        kth = least[q]
        for b in np.argsort(-bound.astype(float), kind="stable"):
            if kth is not None and bound[b] < kth:
                if vectors.dtype != object:
                    break
                continue  # sorted by rounded bounds
            own = slice(cuts[b], cuts[b] + BLOCK)
            scores = vectors[own] @ queries[q]
            keep = ids[own] != query_ids[q]
            best_ids, best = np.concatenate([best_ids, ids[own][keep]]), np.concatenate([best, scores[keep]])
            if len(best) >= k:
                order = np.lexsort((best_ids, -best))[:k] if best.dtype != object else np.array(sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k])
                best_ids, best = best_ids[order], best[order]
                kth = best[-1] if kth is None else max(kth, best[-1])
        out += [(int(query_ids[q]), int(i), int(s)) for i, s in zip(best_ids.tolist(), best.tolist(), strict=True)]
    return out


def _cells(found: list[tuple[int, int, int]]) -> pa.Table:
    names = ("query_id", "vec_id", "score")
    return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(names)})


def group_bounds(grouped: DataFrame) -> DataFrame:
    """(dim, group, top, low): the extremes of each component in each group; a row for thousands of vectors."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = _matrix(table.column("v"), dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "group": table.column("group").slice(0, 1), "top": [v.max(axis=0).tolist()], "low": [v.min(axis=0).tolist()]})

    found = grouped.select("dim", "group", "v").groupBy("dim", "group").applyInArrow(run, "dim int, group string, top array<double>, low array<double>")
    return written(found, "topk-bounds")


def open_groups(queries: DataFrame, bounds: DataFrame, parts: int) -> DataFrame:
    """(vec_id, dim, part, group): the groups, beside its own, that a query has to see, as their bounds reach its k-th score.

    Each part of the queries meets each chunk of the bounds.
    """
    chunks = max(1, -(-bounds.count() // CHUNK_GROUPS))
    held = bounds.withColumn("chunk", F.pmod(F.xxhash64("group"), F.lit(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    none = F.lit(None)
    held = held.select("dim", "chunk", F.col("part").cast("long"), none.cast("long").alias("vec_id"), "group", F.col("top").alias("v"), "low", none.cast("long").alias("least"))
    asks = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = asks.select("dim", "chunk", F.col("part").cast("long"), "vec_id", "group", "v", none.cast("array<double>").alias("low"), "least")

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        is_query = pc.is_valid(table.column("vec_id"))
        asked, groups = table.filter(is_query), table.filter(pc.invert(is_query))
        q, top, low = _matrix(asked.column("v"), dim), _matrix(groups.column("v"), dim), _matrix(groups.column("low"), dim)
        names, own = np.array(groups.column("group").to_pylist(), object), np.array(asked.column("group").to_pylist(), object)
        least = asked.column("least").to_pylist()
        rows = []
        plus = np.maximum(q, 0)
        reach = (plus @ top.T + (q - plus) @ low.T) if len(q) and len(top) else np.zeros((len(q), len(top)))
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(top), np.abs(low)).T + 1) if reach.size else reach  # of rounding
        for i, vec_id in enumerate(asked.column("vec_id").to_pylist()):
            sees = (names != own[i]) & (True if least[i] is None else reach[i] + slack[i] >= float(least[i]))
            rows += [(vec_id, n) for n in names[sees].tolist()]
        part = table.column("part")[0].as_py()
        return pa.table({
            "vec_id": pa.array([r[0] for r in rows], pa.int64()), "dim": pa.array([dim] * len(rows), pa.int32()),
            "part": pa.array([part] * len(rows), pa.int64()), "group": pa.array([r[1] for r in rows], pa.string()),
        })

    return held.unionByName(asks).groupBy("dim", "chunk", "part").applyInArrow(run, "vec_id long, dim int, part long, group string")


def top_k(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose key is divisible by ``every``, among all rows but its own."""
    vectors = written(integer_vectors(rows, key, vector).dropDuplicates(), "topk-integers")
    vectors = written(with_codes(vectors), "topk-vectors")
    # groups: ranges of (length, code, id) of about GROUP_ROWS vectors; counts of codes are few rows
    counts = vectors.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("dim").orderBy("code").rowsBetween(W.unboundedPreceding, -1))
    places = counts.withColumn("before", F.coalesce(total, F.lit(0)))
    slots = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_ROWS)).cast("long")
    places = places.select("dim", "code", F.floor(F.col("before") / GROUP_ROWS).alias("group0"), slots.alias("slots"))
    grouped = vectors.join(places, ["dim", "code"]).select(
        "vec_id", "dim", "code", "v",
        F.when(F.col("slots") > 1, F.concat_ws("-", "group0", "code", F.pmod(F.xxhash64("vec_id"), "slots"))).otherwise(F.col("group0").cast("string")).alias("group"),
    )
    grouped = written(grouped, "topk-groups")
    result = "query_id long, vec_id long, score long"

    def home(table: pa.Table) -> pa.Table:
        table = table.sort_by([("code", "ascending"), ("vec_id", "ascending")])
        dim = table.column("dim")[0].as_py()
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
        asked = ids % every == 0
        return _cells(search(ids, v, ids[asked], v[asked], np.array([None] * int(asked.sum()), object), k))

    first = written(grouped.groupBy("dim", "group").applyInArrow(home, result), "topk-home")
    start = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("least", F.when(F.col("n") >= k, F.col("least"))).drop("n")
    queries = grouped.where(F.col("vec_id") % every == 0).join(start.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    queries = written(queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))), "topk-queries")
    open_ = written(open_groups(queries, group_bounds(grouped), parts), "topk-open")
    asking = queries.withColumnRenamed("group", "own_group").join(open_, ["vec_id", "dim", "part"]).select(
        "dim", "group", "part", "vec_id", "code", "v", "least", F.lit(True).alias("asks")
    )
    held = grouped.join(open_.select("dim", "group", "part").distinct(), ["dim", "group"]).select(
        "dim", "group", "part", "vec_id", "code", "v", F.lit(None).cast("long").alias("least"), F.lit(False).alias("asks")
    )

    def cell(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        asks = table.column("asks").to_numpy()
        own = table.filter(pa.array(~asks)).sort_by([("code", "ascending"), ("vec_id", "ascending")])
        ask = table.filter(pa.array(asks))
        if not own.num_rows or not ask.num_rows:
            return _cells([])
        least = np.array(ask.column("least").to_pylist(), object)
        return _cells(search(own.column("vec_id").to_numpy(), _matrix(own.column("v"), dim), ask.column("vec_id").to_numpy(), _matrix(ask.column("v"), dim), least, k))

    rest = asking.unionByName(held).groupBy("dim", "group", "part").applyInArrow(cell, result)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
