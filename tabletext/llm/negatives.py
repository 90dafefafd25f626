"""Hard negatives from labelled vectors, by a vector-approximation file.

The file has a row for some thousands of vectors: ids, labels, vectors of whole numbers, and for each component its cells
(256, of equal numbers of these vectors, with the least and largest value in each) and each vector's cell, a byte. For a
query, a table gives what each cell adds to the score at least and at most; summed over a vector's bytes these are bounds of
its score. Only vectors whose bounds reach a window that is not yet filled by better ones are scored exactly.

First each anchor finds its positives, the best rows of its own label; each positive's score sets a window, for which the
best rows of other labels inside it are found. Anchors meet the file in cells (a row of the file, a part of the anchors) of
bounded size; every cell gives a few rows an anchor, and the best of all cells are ranked.

Edge cases: rows with a null key, label or vector, or a null or non-finite component, take no part, nor do vectors whose
squared length is 2**62 or more (scores would leave 64 bits); vectors of different lengths are not compared; of rows with
one key and length the first by label and vector counts; ties go to the smaller key; an anchor without positives, and a positive
without negatives in its window, give no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.llm.common import drop_written, read, written

SCALE = 256
#: Vectors in a row of the file, and anchors that meet it at once, about.
GROUP_ROWS, ANCHOR_ROWS = 8192, 4096
CELLS = 256


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, v): components as 32-bit whole numbers, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * batch.column(2).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
                squares = np.concatenate([[0.0], np.cumsum(np.where(np.abs(x) < 2.0**31, x * x, 0))])
            outside = np.concatenate([[0], np.cumsum(~(np.abs(x) < 2.0**31))])
            ends = np.cumsum(sizes)
            use = (sizes > 0) & (outside[ends] == outside[ends - sizes]) & (squares[ends] - squares[ends - sizes] < 2.0**62)
            whole = np.where(np.abs(x) < 2.0**31, x, 0).astype(np.int32)
            data = [whole[j - n : j].tobytes() for j, n in zip(ends[use].tolist(), sizes[use].tolist(), strict=True)]
            kept = batch.filter(pa.array(use))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(sizes[use].astype(np.int32)), pa.array(data, pa.binary())], names=["vec_id", "label", "dim", "v"]
            )

    taken = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long"), F.col(label).cast("long"), F.col(vector))
    return taken.mapInArrow(run, "vec_id long, label long, dim int, v binary")


class Approximation(NamedTuple):
    """A row of the file: vectors, cells (component x cell: least and largest value) and the cell of each (component x vector)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    most: np.ndarray
    codes: np.ndarray

    def reach(self, query: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The largest score that each vector can have with a query. The smallest one is what it can reach with the opposite query, negated."""
        q = query.astype(np.int64)[:, None]
        table, codes = np.maximum(q * self.least, q * self.most), self.codes if rows is None else self.codes[:, rows]
        total = np.zeros(codes.shape[1], np.int64)
        for t, c in zip(table, codes, strict=True):
            total += t[c]
        return total

    def bounded(self, query: np.ndarray) -> bool:
        """Whether the bounds of a query stay within 64 bits."""
        return float(np.abs(query).astype(float) @ np.maximum(np.abs(self.least), np.abs(self.most)).max(axis=1).astype(float)) < 2.0**62

    def best(self, query: np.ndarray, rows: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> tuple[list[np.ndarray], int]:
        """For each window (least and largest score, None: open) the best k of some vectors inside it, ties to smaller ids, and how many were scored."""
        if self.bounded(query) and len(rows):
            high = self.reach(query, None if len(rows) == len(self.ids) else rows)
            if all(start is not None for start, _ in windows):
                at = high >= min((start for start, _ in windows), default=0)
                rows, high = rows[at], high[at]
            low = -self.reach(-query.astype(np.int64), rows) if any(end is not None for _, end in windows) else None
            maybe = np.zeros(len(rows), bool)
            for start, end in windows:
                meets = np.ones(len(rows), bool) if start is None else high >= start
                if end is not None:
                    meets &= low <= end
                    sure = low[(high <= end) & (low >= start if start is not None else True)]
                elif len(rows) > k:  # some real scores, of those that reach highest
                    sure = self.vectors[rows[np.argpartition(-high, k - 1)[:k]]].astype(np.int64) @ query.astype(np.int64)
                    sure = sure[sure >= start] if start is not None else sure
                else:
                    sure = high[:0]
                if len(sure) >= k:  # k vectors surely inside score this or more
                    meets &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                maybe |= meets
            rows = rows[maybe]
        scores = self.vectors[rows].astype(np.int64) @ query.astype(np.int64)
        ids, out = self.ids[rows], []
        for start, end in windows:
            at = np.flatnonzero((scores >= start if start is not None else True) & (scores <= end if end is not None else np.ones(len(scores), bool)))
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            out.append(np.column_stack([ids[at], scores[at]]))
        return out, len(rows)


def approximate(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Approximation:
    """Cells of equal numbers of the vectors for each component; equal values share a cell."""
    n, dim = vectors.shape
    least, most, cells = np.zeros((dim, CELLS), np.int64), np.zeros((dim, CELLS), np.int64), np.zeros((dim, n), np.uint8)
    for d in range(dim):
        x = np.sort(vectors[:, d])
        edges = np.unique(x[(np.arange(1, CELLS) * n) // CELLS])  # first values of cells
        cells[d] = np.searchsorted(edges, vectors[:, d], "right")
        starts = np.unique(np.concatenate([[0], np.searchsorted(x, edges)]))
        of = np.searchsorted(edges, x[starts], "right")
        least[d, of], most[d, of] = x[starts], x[np.append(starts[1:], n) - 1]
    return Approximation(ids, labels, vectors, least, most, cells)


_FILE = "dim int, group long, n int, ids binary, labels binary, vectors binary, least binary, most binary, codes binary"


def approximation_file(vectors: DataFrame) -> DataFrame:
    """Rows of the file, of (vec_id, label, dim, v, group): one for each dim and group."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("label").to_pylist(), table.column("v").to_pylist(), strict=True), key=lambda r: r[:2])
        first = _one_an_id(rows)
        made = approximate(*[np.array([r[i] for r in first], np.int64) for i in (0, 1)], np.frombuffer(b"".join(r[2] for r in first), np.int32).reshape(-1, dim))
        columns = {"dim": pa.array([dim], pa.int32()), "group": table.column("group").slice(0, 1), "n": pa.array([len(first)], pa.int32())}
        return pa.table(columns | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ids", "labels", "vectors", "least", "most", "codes"), made, strict=True)})

    return vectors.groupBy("dim", "group").applyInArrow(run, _FILE)


def _one_an_id(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Of rows with one id, the first by label and vector."""
    held: dict[int, tuple[int, list[int], bytes]] = {}
    for vec_id, label, v in rows:
        new = (label, np.frombuffer(v, np.int32).tolist() if vec_id in held else [], v)
        old = held.get(vec_id)
        if old is not None and not old[1]:
            old = (old[0], np.frombuffer(old[2], np.int32).tolist(), old[2])
        held[vec_id] = new if old is None else min(old, new)
    return [(k, label, v) for k, (label, _, v) in held.items()]


def _opened(row: dict) -> Approximation:
    n, dim = row["n"], row["dim"]
    ints = lambda c: np.frombuffer(row[c], np.int64)
    return Approximation(
        ints("ids"), ints("labels"), np.frombuffer(row["vectors"], np.int32).reshape(n, dim),
        ints("least").reshape(-1, CELLS), ints("most").reshape(-1, CELLS), np.frombuffer(row["codes"], np.uint8).reshape(-1, n),
    )


def _rows(names: list[str], found: list[np.ndarray]) -> pa.Table:
    whole = np.concatenate(found).astype(np.int64) if found else np.zeros((0, len(names)), np.int64)
    return pa.table({n: pa.array(whole[:, i]) for i, n in enumerate(names)})


def in_cells(file: DataFrame, anchors: DataFrame, groups: int, parts: int, run: Callable[[list[Approximation], pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(approximation, anchors)`` for every row of the file and every part of the anchors of its length."""
    keys = ["dim", "group", "part"]
    held = file.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = anchors.withColumn("asked_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumnsRenamed({"dim": "asked_dim", "part": "asked_part"})

    def cell(own: pa.Table, ask: pa.Table) -> pa.Table:
        return run([_opened(r) for r in own.to_pylist()], ask)

    return held.groupBy(*keys).cogroup(asked.groupBy("asked_dim", "asked_group", "asked_part")).applyInArrow(cell, schema)


def mine_negatives(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key is divisible by ``every``, with their best ``positives`` of one label; for each of these the
    best ``negatives`` of other labels whose score is between ``low`` and ``high`` percent of the positive's.
    """
    vectors = written(whole_vectors(rows, key, vector, label, scale), "negatives-vectors")
    groups = max(1, -(-vectors.count() // GROUP_ROWS))
    grouped = vectors.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    file = written(approximation_file(grouped), "negatives-file")
    part_of = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(n)).cast("int")
    parts = max(1, -(-vectors.where(F.col("vec_id") % every == 0).count() // ANCHOR_ROWS))

    def own_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of the file, with their vectors."""
        for batch in batches:
            for row in batch.to_pylist():
                one = _opened(row)
                at = np.flatnonzero(one.ids % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.ids[at]), pa.array(one.labels[at]), pa.array(np.full(len(at), row["dim"], np.int32)), pa.array([x.tobytes() for x in one.vectors[at]], pa.binary())],
                    names=["vec_id", "label", "dim", "v"],
                )

    anchors = written(file.mapInArrow(own_anchors, "vec_id long, label long, dim int, v binary").withColumn("part", part_of(parts)), "negatives-anchors")

    def find_positives(own: list[Approximation], ask: pa.Table) -> pa.Table:
        found = []
        for one in own:
            for q in ask.to_pylist():
                rows = np.flatnonzero((one.labels == q["label"]) & (one.ids != q["vec_id"]))
                (best,), _ = one.best(np.frombuffer(q["v"], np.int32), rows, [(None, None)], positives)
                found.append(np.column_stack([np.full(len(best), q["vec_id"]), best]))
        return _rows(["anchor_id", "positive_id", "score"], found)

    near = in_cells(file, anchors, groups, parts, find_positives, "anchor_id long, positive_id long, score long")
    turn = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    near = near.withColumn("turn", turn).where(F.col("turn") <= positives).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    asking = written(anchors.join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "negatives-asking")

    def find_negatives(own: list[Approximation], ask: pa.Table) -> pa.Table:
        found = []
        for one in own:
            for q in ask.to_pylist():
                # low * positive <= 100 * negative <= high * positive
                wanted = [(p["positive_id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in q["positives"]]
                wanted = [w for w in wanted if w[2] <= w[3]]
                rows = np.flatnonzero(one.labels != q["label"])
                if not wanted or not len(rows):
                    continue
                best, _ = one.best(np.frombuffer(q["v"], np.int32), rows, [w[2:] for w in wanted], negatives)
                for (positive, score, *_), b in zip(wanted, best, strict=True):
                    found.append(np.column_stack([np.tile([q["vec_id"], positive, score], (len(b), 1)).astype(np.int64), b]))
        return _rows(["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], found)

    hard = in_cells(file, asking, groups, parts, find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = hard.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    drop_written(vectors)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings, after the labels of every seventh key move on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine_negatives(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
