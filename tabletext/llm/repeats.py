"""Removal of repeated passages, found by recompression.

Words get names, 128-bit digests of their bytes. A round of recompression names each run of equal symbols, then each pair of a left and a right
symbol (a hash of the name decides the side), so a name depends only on the words under it and equal passages get equal
names everywhere, without any table. What stands at the rim of a window may be joined with words outside it; each round,
the window gives up those symbols, and what is left is the same wherever the window's words occur. The longest symbol
left (the first of the greatest by name among equals) is the window's anchor: equal windows share anchor and offset.

Neighbouring windows with one anchor form a segment (anchor, digest of all its words, text, first window, number). Segments
meet by anchor in buckets of measured size: an anchor that occurs once is gone; a segment that occurs twice is repeated as a whole; the
rest (segments that only partly agree, at the rims of repeated passages) are settled window by window, by a digest of all
words, in a second meeting. Windows without an anchor, such as runs of one word, meet by their own digest. Texts are told
apart by 128-bit digests; segments by anchor and digest, 125 bits together; windows by 122 bits. Digests of ranges are
polynomials modulo a prime over names that are cryptographic, so no regular sequence of letters or words makes them meet. Within a task, equal
segments and windows are combined before they are sent, so that a passage in very many documents stays small.

Edge cases: null and empty texts have no words; texts with fewer than ``window`` words lose nothing; documents with equal
texts lose all words from ``window`` words on; keys may be null or repeated; an empty table gives an empty result; columns
other than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.llm.common import Ranges, drop_written, mix, read, row_starts, text_chunks, text_ids, words_of, written

WINDOW = 35
ROUNDS = 3
#: Bytes of text whose segments are combined and sent together, and of segments in a bucket, about.
PACK_BYTES, BUCKET_BYTES = 1_000_000, 16 << 20
FULL, PART, WITNESS = 2, 1, 3


def _first_of_greatest(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the first greatest rank in each non-empty range [lo, hi)."""
    size = hi - lo
    table, step = np.arange(len(rank)), 1
    out = np.zeros(len(lo), np.int64)
    while True:
        now = np.flatnonzero((size >= step) & (size < 2 * step))
        a, b = table[lo[now]], table[hi[now] - step]
        out[now] = np.where(rank[a] >= rank[b], a, b)
        if len(size) == 0 or size.max() < 2 * step:
            return out
        left, right = table[:-step], table[step:]
        wide = table.copy()
        wide[:-step] = np.where(rank[left] >= rank[right], left, right)
        table, step = wide, 2 * step


def anchors(names: np.ndarray, rows: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of window, name of its anchor, place of the anchor, its round; round 0: the window has none)."""
    starts = np.arange(max(0, len(names) - window + 1))
    starts = starts[rows[starts] == rows[starts + window - 1]] if len(starts) else starts
    lo, hi, alive = starts.copy(), starts + window, np.ones(len(starts), bool)
    symbol, place, row = names, np.arange(len(names)), rows
    name, where, found = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for turn in range(1, rounds + 1):
        if not alive.any():
            break
        # runs of equal symbols
        new = np.ones(len(symbol), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
        run = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(symbol)))
        lo, hi = run[np.where(alive, lo, 0)] + 1, run[np.where(alive, hi, 1) - 1]
        alive &= hi > lo
        symbol = np.where(count == 1, symbol[at], mix(symbol[at] + mix(count.astype(np.uint64))))
        place, row = place[at], row[at]
        # pairs of a left and a right symbol
        right = mix(symbol ^ np.uint64(turn * 7919)) >> np.uint64(63) == 1
        joined = np.zeros(len(symbol), bool)  # with the symbol before it
        joined[1:] = right[1:] & ~right[:-1] & (row[1:] == row[:-1])
        head = np.cumsum(~joined) - 1
        lo, hi = np.where(alive, lo, 0), np.where(alive, hi, 1)
        lo = lo + right[lo]
        hi = hi - ~right[hi - 1]
        alive &= hi > lo
        lo, hi = np.where(alive, lo, 0), np.where(alive, hi, 1)
        lo, hi = head[lo], head[hi - 1] + 1
        at = np.flatnonzero(~joined)
        two = np.zeros(len(symbol), bool)
        two[:-1] = joined[1:]
        second = symbol[np.minimum(at + 1, len(symbol) - 1)]
        symbol = np.where(two[at], mix(mix(symbol[at]) * np.uint64(3) + second), symbol[at])
        place, row = place[at], row[at]
        length = np.diff(np.append(place, len(names)))
        rank = (np.minimum(length, 255).astype(np.uint64) << np.uint64(56)) | (mix(symbol) >> np.uint64(8))
        live = np.flatnonzero(alive)
        best = _first_of_greatest(rank, lo[live], hi[live])
        name[live], where[live], found[live] = mix(symbol[best] + np.uint64(turn)), place[best], turn
    return starts, name, where, found


def segments(names: np.ndarray, rows: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(anchor, digest of all words, first window, number of windows): maximal runs of windows with one anchor."""
    starts, name, where, found = anchors(names[0], rows, window, rounds)
    ranges = Ranges(names)
    bare = found == 0
    if bare.any():
        name[bare] = ranges(starts[bare], starts[bare] + window)[1]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (where[1:] != where[:-1]) | (found[1:] != found[:-1]) | bare[1:]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first = starts[at]
    offset = np.where(bare[at], 0, where[at] - first).astype(np.uint64)
    return name[at], mix(ranges(first, first + count + window - 1)[0] + mix(offset)), first, count


def _packed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each bucket that has entries, with its entries' columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    which, starts = np.unique(bucket[order], return_index=True)
    spans = list(zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=False))
    arrays = [pa.array(which.astype(np.int64)), *[pa.array([c[i:j].tobytes() for i, j in spans], pa.binary()) for c in columns]]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *names])


def _unpacked(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _digests(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)


def _binaries(ids: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Marks the first row of each group of equal rows in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _sizes(new: np.ndarray) -> np.ndarray:
    """Size of the group of each row."""
    sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
    return np.repeat(sizes, sizes)


def base_rows(docs: DataFrame) -> DataFrame:
    """(key, text_id, n_words, whole): ``whole`` is the digest of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = batch.column(1)
            words = [t.encode().split() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(text_ids(texts), pa.binary()), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                ],
                names=["key", "text_id", "n_words", "whole"],
            )

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, text_id binary, n_words long, whole string")


def segment_states(docs: DataFrame, window: int, rounds: int, buckets: int) -> DataFrame:
    """(text_id, first, count, state) of the segments that may be repeated."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # digests of the task's texts
        for batch in text_chunks(batches, size=PACK_BYTES):
            ids = text_ids(batch.column(0))
            fresh = []
            for i, t in enumerate(ids):
                if t not in seen:
                    seen.add(t)
                    fresh.append(i)
            batch, ids = batch.take(pa.array(fresh, pa.int64())), _digests([ids[i] for i in fresh])
            names, rows = words_of(batch.column(0))
            begin = row_starts(rows, len(ids))
            anchor, words, first, count = segments(names, rows, window, rounds)
            owner = rows[first] if len(first) else first
            text, local = ids[owner], (first - begin[owner]).astype(np.uint32)
            order = np.lexsort((words, anchor))
            anchor, words, text, local, count = (c[order] for c in (anchor, words, text, local, count.astype(np.uint32)))
            new = _groups(anchor, words)
            twice = _sizes(new) > 1
            # the first of equal segments goes to its anchor's bucket, marked; the others are known to be repeated
            mark = count | (twice.astype(np.uint32) << np.uint32(31)) | ((~new).astype(np.uint32) << np.uint32(30))
            bucket = np.where(new, anchor, mix(text[:, 0])) % np.uint64(buckets)
            yield _packed(bucket, [anchor, words, text, local, mark], ["anchor", "words", "text", "first", "mark"])

    def meet(table: pa.Table) -> pa.Table:
        anchor, words, text = (_unpacked(table, c, np.uint64) for c in ("anchor", "words", "text"))
        text = text.reshape(-1, 2)
        first, mark = _unpacked(table, "first", np.uint32), _unpacked(table, "mark", np.uint32)
        known = (mark >> np.uint32(30)) & np.uint32(1) == 1
        sure = text[known], first[known], mark[known] & np.uint32(0x3FFFFFFF), np.full(int(known.sum()), FULL)
        anchor, words, text, first, mark = (c[~known] for c in (anchor, words, text, first, mark))
        order = np.lexsort((mark, first, text[:, 1], text[:, 0], words, anchor))
        anchor, words, text, first, mark = (c[order] for c in (anchor, words, text, first, mark))
        last = np.ones(len(anchor), bool)  # of equal texts that several tasks sent, keep one entry, a marked one if any
        last[:-1] = _groups(anchor, words, text[:, 0], text[:, 1], first)[1:]
        anchor, words, text, first, mark = (c[last] for c in (anchor, words, text, first, mark))
        twice = mark >> np.uint32(31) == 1
        per_anchor = _groups(anchor)
        kinds = _groups(anchor, words)
        at = np.flatnonzero(per_anchor)
        entries = _sizes(per_anchor)
        mixed = np.repeat(np.add.reduceat(kinds.astype(int), at), np.diff(np.append(at, len(anchor)))) > 1 if len(at) else kinds
        some = np.flatnonzero(kinds)
        doubled = np.repeat(np.logical_or.reduceat(twice, some), np.diff(np.append(some, len(anchor)))) if len(some) else twice
        full = doubled | (_sizes(kinds) > 1)
        keep = (entries > 1) | full
        state = np.where(full, np.where(mixed & kinds, WITNESS, FULL), PART)
        parts = text[keep], first[keep], mark[keep] & np.uint32(0x3FFFFFFF), state[keep]
        columns = [np.concatenate([a, b]) for a, b in zip(sure, parts, strict=True)]
        return pa.Table.from_arrays([_binaries(columns[0]), *[pa.array(c.astype(np.int32)) for c in columns[1:]]], names=["text_id", "first", "count", "state"])

    packed = docs.select("text").mapInArrow(pack, "bucket long, anchor binary, words binary, text binary, first binary, mark binary")
    return packed.groupBy("bucket").applyInArrow(meet, "text_id binary, first int, count int, state int")


def repeated_windows(joined: DataFrame, window: int, buckets: int) -> DataFrame:
    """(text_id, first): windows of undecided segments that occur twice, from (text_id, text, found) rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, size=PACK_BYTES):
            names, rows = words_of(batch.column(1))
            begin = row_starts(rows, batch.num_rows)
            found = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            flat = found.flatten()
            first, count, state = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            open_ = (state == PART) | (state == WITNESS)
            first, count, owner = first[open_], count[open_], owner[open_]
            total = int(count.sum())
            ends = np.cumsum(count)
            local = np.repeat(first - (ends - count), count) + np.arange(total)
            owner = np.repeat(owner, count)
            start = begin[owner] + local
            h, check = Ranges(names)(start, start + window)
            text = _digests(batch.column(0).to_pylist())[owner]
            order = np.lexsort((local, text[:, 1], text[:, 0], check, h))
            h, check, text, local = (c[order] for c in (h, check, text, local))
            one = _groups(h, check, text[:, 0], text[:, 1], local)
            h, check, text, local = (c[one] for c in (h, check, text, local))
            new = _groups(h, check)
            twice = _sizes(new) > 1
            mark = local.astype(np.uint32) | (twice.astype(np.uint32) << np.uint32(31)) | ((~new).astype(np.uint32) << np.uint32(30))
            yield _packed(np.where(new, h, mix(text[:, 0])) % np.uint64(buckets), [h, check, text, mark], ["h", "check", "text", "mark"])

    def meet(table: pa.Table) -> pa.Table:
        h, check, text = (_unpacked(table, c, np.uint64) for c in ("h", "check", "text"))
        text, mark = text.reshape(-1, 2), _unpacked(table, "mark", np.uint32)
        known = (mark >> np.uint32(30)) & np.uint32(1) == 1
        sure = text[known], mark[known] & np.uint32(0x3FFFFFFF)
        h, check, text, mark = (c[~known] for c in (h, check, text, mark))
        local = mark & np.uint32(0x3FFFFFFF)
        order = np.lexsort((mark, local, text[:, 1], text[:, 0], check, h))
        h, check, text, mark, local = (c[order] for c in (h, check, text, mark, local))
        last = np.ones(len(h), bool)
        last[:-1] = _groups(h, check, text[:, 0], text[:, 1], local)[1:]
        h, check, text, mark, local = (c[last] for c in (h, check, text, mark, local))
        new = _groups(h, check)
        some = np.flatnonzero(new)
        twice = np.repeat(np.logical_or.reduceat(mark >> np.uint32(31) == 1, some), np.diff(np.append(some, len(h)))) if len(some) else new
        keep = twice | (_sizes(new) > 1)
        columns = np.concatenate([sure[0], text[keep]]), np.concatenate([sure[1], local[keep]])
        return pa.Table.from_arrays([_binaries(columns[0]), pa.array(columns[1].astype(np.int32))], names=["text_id", "first"])

    packed = joined.select("text_id", "text", "found").mapInArrow(pack, "bucket long, h binary, check binary, text binary, mark binary")
    return packed.groupBy("bucket").applyInArrow(meet, "text_id binary, first int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every document; with ``with_text`` also ``kept``, the words left."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = written(base_rows(docs), "repeats-base")
    n_words = base.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_words * 6 // BUCKET_BYTES)  # some six bytes of segments a word
    # one document stands for each text
    texts = base.where(F.col("n_words") >= window).groupBy("text_id").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts, "repeats-texts")  # joins with it can then split the rows of a hot text
    states = segment_states(docs, window, rounds, buckets)
    found = (
        states.join(texts, "text_id")
        .where(f"copies = 1 OR state <> {FULL}")
        .groupBy("text_id")
        .agg(F.first("rep").alias("rep"), F.first("copies").alias("copies"), F.collect_list(F.struct("first", "count", "state")).alias("found"))
    )  # at most one document's segments
    found = written(found, "repeats-found")

    def with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            ids = pa.array(text_ids(batch.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), ids], names=["key", "text", "text_id"])

    kind = docs.schema["key"].dataType.simpleString()
    texted = docs.mapInArrow(with_ids, f"key {kind}, text string, text_id binary").join(
        found.withColumnRenamed("text_id", "found_id"), F.col("text_id").eqNullSafe(F.col("found_id")) & F.col("key").eqNullSafe(F.col("rep"))
    )
    open_ = texted.where(F.exists("found", lambda s: s["state"] != FULL))
    windows = repeated_windows(open_, window, buckets)
    places = windows.groupBy("text_id").agg(F.collect_list("first").alias("places"))  # at most one document's windows
    places = places.join(found.where("copies = 1").select("text_id", "rep"), "text_id").select(F.col("text_id").alias("place_id"), F.col("rep").alias("place_key"), "places")
    single = texted.where("copies = 1").join(
        places, F.col("text_id").eqNullSafe(F.col("place_id")) & F.col("key").eqNullSafe(F.col("place_key")), "left"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found, places in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + window + 1, np.int64)
                for s in found.as_py():
                    if s["state"] != PART:
                        edge[s["first"]] += 1
                        edge[s["first"] + s["count"] + window - 1] -= 1
                at = np.array(places.as_py() or [], np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]],
                names=["cut_key", "cut_id", "cut", "cut_sha256", "cut_text"],
            )

    done = single.select("key", "text_id", "text", "found", "places").mapInArrow(
        cut, f"cut_key {kind}, cut_id binary, cut long, cut_sha256 string, cut_text string"
    )
    copies = texts.where("copies > 1").select(F.col("text_id").alias("copied"))
    # by key and text: rows of one text do not meet in one task
    same = F.col("key").eqNullSafe(F.col("cut_key")) & (F.col("text_id") == F.col("cut_id"))
    result = base.join(copies, F.col("text_id") == F.col("copied"), "left").join(done, same, "left")
    all_gone = F.col("copied").isNotNull()
    result = result.select(
        "key",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "whole")).alias("kept_sha256"),
        *([F.when(all_gone, F.lit("")).otherwise(F.col("cut_text")).alias("kept")] if with_text else []),
    )
    return result


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM
    (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM p JOIN r USING (h)),
g AS (SELECT DISTINCT doc_id, i + j AS k FROM s, generate_series(0, 34) t(j)),
l AS (SELECT doc_id, list(k) AS ks FROM g GROUP BY doc_id),
m AS (SELECT w.doc_id, ws, coalesce(ks, []) AS ks FROM w LEFT JOIN l USING (doc_id)),
u AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
x AS (SELECT u.doc_id, i, ws[i] AS v FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.k = u.i),
t AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY x.i) AS kept FROM x GROUP BY x.doc_id)
SELECT m.doc_id, len(ws)::BIGINT AS n_words, len(ks)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM m LEFT JOIN t ON m.doc_id = t.doc_id
"""
