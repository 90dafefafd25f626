"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes some twenty statistics (lengths, letter and sign shares, repetition of words and lines). A random
Fourier map approximates a Gaussian kernel over them; each partition of the labelled rows sums its part of the normal
equations, the sums are added up by Spark, and the ridge solution is the raw score. Pool-adjacent-violators over a
histogram of raw scores turns it into a probability.

Every labelled row whose ``learn`` flag holds takes part. Edge cases: a null or empty text has the statistics of no words
and the score that those get; equal texts have equal scores; without usable labels every score is 0.5; an empty table
gives an empty result; other columns are not read. A document with several labels counts as good only if all say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.llm.common import drop_written, read, span_codes, text_bytes, text_chunks, word_spans, written
from tabletext.llm.toxicity import held_out

STATISTICS = [
    "log words", "log bytes", "word length", "long words", "capitals", "loud words", "signs", "digits", "high bytes", "distinct words",
    "word repeats", "commonest word", "lines", "repeated lines", "line length", "sign words", "bar words", "sentence ends", "distinct pairs",
    "commas", "shortness",
]
FEATURES = 192
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3
BINS = 2000
#: Features are rounded to multiples of 1 / SCALE before they are summed.
SCALE = float(1 << 12)
#: Partitions that sum normal equations, at most: bounds the rows that the sums are made of.
SUMMERS = 128


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often the commonest occurs."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """STATISTICS of each text."""
    n = len(texts)
    data, offsets = text_bytes(texts)
    size = np.diff(offsets).astype(float)
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n).astype(float)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    high, digit = data >= 128, (data >= 48) & (data <= 57)
    comma, dot = (data == 44), (data == 46)
    sign = (data > 32) & ~(upper | lower | high | digit | comma | dot)
    letters = sums(upper | lower)
    codes, kinds = span_codes(data, starts, ends)
    codes = codes.astype(np.int64)
    length = ends - starts
    by = lambda keep: np.bincount(rows[keep], minlength=n).astype(float)
    distinct, most = _distinct(rows, codes, n)
    again = np.zeros(len(rows), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    pairs = codes[1:] * len(kinds) + codes[:-1]
    same = rows[1:] == rows[:-1]
    distinct_pairs, _ = _distinct(rows[1:][same], pairs[same], n)
    last, first = data[ends - 1] if len(ends) else data, data[starts] if len(starts) else data
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else data
    capital = lambda x: (x >= 65) & (x <= 90)
    # lines: runs between line feeds
    breaks = np.flatnonzero(data == 10)
    line_rows = np.searchsorted(offsets, breaks, "right") - 1
    full = np.flatnonzero(size > 0)
    cut = np.concatenate([offsets[full], breaks + 1])
    stop = np.concatenate([breaks, offsets[full + 1]])
    owner = np.sort(np.concatenate([full, line_rows]))
    cut, stop = np.sort(cut), np.sort(stop)
    solid = stop > cut
    cut, stop, owner = cut[solid], stop[solid], owner[solid]
    lines = np.bincount(owner, minlength=n).astype(float)
    line_kinds, _ = _distinct(owner, span_codes(data, cut, stop)[0].astype(np.int64), n)
    return np.column_stack([
        np.log1p(words), np.log1p(size), np.minimum(_share(size, words), 40) / 10, _share(by(length > 20), words), _share(sums(upper), letters),
        _share(by(capital(first) & capital(second)), words), _share(sums(sign), size), _share(sums(digit), size), _share(sums(high), size),
        _share(distinct, words), _share(by(again), words), _share(most, words), np.log1p(lines), 1 - _share(line_kinds, lines),
        np.log1p(_share(size, lines)), _share(by((last >= 33) & (last <= 47) & (last != 44) & (last != 46)), words),
        _share(by((length == 1) & (first == 124)), words), _share(by(last == 46), words), _share(distinct_pairs, words - 1),
        _share(by(last == 44), words), 1 / (1 + words / 10),
    ])


class FourierMap:
    """A fixed random map of standardized statistics, with the statistics themselves and a constant beside it."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.deviation = mean, np.maximum(deviation, 1e-6)
        self.directions = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phases), 0.1 * x, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


def statistics_of(docs: DataFrame) -> DataFrame:
    """(key, stats) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            stats = statistics(batch.column(1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * len(STATISTICS), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "stats"])

    return docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, stats array<float>")


def normal_equations(taught: DataFrame, mapping: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over (stats, y) rows, in whole multiples of 1 / SCALE: the same in any order of tasks."""
    d = FEATURES + len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            z, y = mapping(_matrix(batch, "stats")), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            z = np.rint(z * SCALE)  # products of whole numbers below 2 ** 53 are exact in doubles
            total += z.T @ np.column_stack([z, np.rint(y * SCALE)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.rint(total.ravel()).astype(np.int64))], names=["i", "v"])

    exact = F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    rows = taught.select("stats", "y").coalesce(SUMMERS).mapInArrow(run, "i long, v long").groupBy("i").agg(exact).collect()
    total = np.zeros(d * (d + 1))
    for r in rows:
        total[r["i"]] = float(r["v"]) / SCALE**2
    total = total.reshape(d, d + 1)
    return total[:, :d], total[:, d]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and values, increasing in both."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted) for every document; ``learn`` says which labels may be used."""
    seen = written(statistics_of(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))), "quality-statistics")
    known = labels.where(learn & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("y"))
    taught = written(seen.join(known, "key").select("stats", F.col("y").cast("double").alias("y")), "quality-taught")
    moments = taught.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.col("stats")[i]), 6).alias(f"m{i}") for i in range(len(STATISTICS))],
        *[F.round(F.stddev_pop(F.col("stats")[i]), 6).alias(f"s{i}") for i in range(len(STATISTICS))],
    ).first()
    kind = f"key {seen.schema['key'].dataType.simpleString()}, score double, predicted int"
    if not moments["n"]:
        return seen.select("key", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    mapping = FourierMap(*[np.array([moments[f"{c}{i}"] for i in range(len(STATISTICS))], float) for c in "ms"])
    zz, zy = normal_equations(taught, mapping)
    weights = np.linalg.solve(zz + RIDGE * moments["n"] * np.eye(len(zy)) / len(zy), zy)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BINS, 2))
        for batch in batches:
            raw = mapping(_matrix(batch, "stats")) @ weights
            at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(int)
            np.add.at(total, at, np.column_stack([np.ones(len(at)), batch.column(1).to_numpy(zero_copy_only=False)]))
        full = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full, 0]), pa.array(total[full, 1])], names=["bin", "n", "good"])

    counted = taught.select("stats", "y").mapInArrow(bins, "bin long, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rows = sorted((r["bin"], r["n"], r["good"]) for r in counted.collect())  # at most BINS rows
    at, n, good = (np.array(c, float) for c in zip(*rows, strict=True))
    centres, values = isotonic((at + 0.5) / BINS * 3 - 1, good / n, n)
    centres = np.concatenate([[-1.0], centres, [2.0]])
    values = np.concatenate([[values[0] * 0.5], values, [values[-1] + (1 - values[-1]) * 0.5]])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.round(mapping(_matrix(batch, "stats")) @ weights, 9)  # products of matrices can differ in the last places by batch
            score = np.clip(np.interp(raw, centres, values), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["key", "score", "predicted"])

    return seen.mapInArrow(classify, kind)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return scored.select(F.col("key").alias("doc_id"), F.coalesce(held_out("key", 4, 2), F.lit(False)).alias("held_out"), "score", "predicted")
