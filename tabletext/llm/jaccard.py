"""N-gram Jaccard join by PartEnum signatures, and the classes of near-duplicates it links.

Documents are sets of word 5-grams. Equal sets are one class, named by a 128-bit digest of the set. For two classes to link
(Jaccard similarity of at least 0.75), their sets may differ in at most (|A| + |B|) / 7 elements.

Signatures: sets fall into size bands [2**m, 2**(m+1)); a set whose larger partners may lie in the next band signs for that
band as well. A band divides the feature domain, by hash, into ``n1`` parts of ``n2`` cells each. Of two linked sets, some
part differs in at most ``k2`` cells, so they agree on ``n2 - k2`` cells of it: every subset of that many cells is
enumerated, and a signature is what a set holds in the cells of one subset (``scheme``). Subsets that a set leaves empty
are not signed. What the differences cannot spoil and is not empty is the number of signatures that a set must share with
each linked one (``need``). Where that is none (a small set in few cells), the set signs under a second division as well,
and so on until it has a need: two linked sets that both have none meet under the next division.

First, sets that have no partner are left out, exactly: in one order of all shingles (by hash), the first
``prefix_size`` ones of two linked sets share at least ``prefix_need`` (the prefix filter), so a class of whose prefix
fewer shingles occur in other classes is alone. Only the rest is signed.

Candidates: prefixes and signatures meet in buckets of measured size. A class that has fewer shared signatures than it
needs is alone; of the others, each keeps its rarest ones, all but ``need - 1`` (two linked classes still share one).

Verification: each class first meets one centre, the smallest class that it shares a signature with, is compared exactly,
and what links is contracted; so a large group of copies of one text is gone after work in proportion to its size. Where
classes not yet contracted still share signatures, the groups of these are cut into blocks of bounded size, each pair of
blocks is searched exactly, breadth first, and classes that are already contracted are not compared. No pair list is
built, and only links of a spanning forest leave a task.

Edge cases: a null or empty text has an empty set and links with nothing; fewer than five words make one feature; a null
key is kept (its component is the smallest key of its class, null if there is none); repeated rows are classmates; an
empty table gives an empty result. Columns other than key and text are not read; input columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletext.llm.common import digest, drop_written, mix, read, row_starts, signed, text_chunks, window_digests, words_of, written
from tabletext.llm.components import components

WIDTH = 5
#: Shingles of a set that is small: a set that differs from it in one shingle need not be linked with it.
SMALL = 8
#: Features in one block of a candidate group; a task holds two blocks.
BLOCK_FEATURES = 500_000
#: Bytes of sets whose signatures are packed together, half of them, and of entries in a bucket, about.
PACK_BYTES, BUCKET_BYTES = 1_000_000, 16 << 20
#: Marks in the highest of a packed signature's 56 bits: several classes of the batch have it; it is no more than one of
#: these; what kind it is (first division of the own band, of the next band, or a later division; 3: a need, not a signature).
SHARED, KNOWN, KIND, BARE = np.uint64(1 << 55), np.uint64(1 << 54), np.uint64(52), np.uint64((1 << 52) - 1)
SHORT = np.uint64((1 << 48) - 1)
#: Divisions that a set is tried under before its elements sign for it; each fails with a chance well below one half.
DIVISIONS = 200


def linked(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int = 75) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _shingles(words: np.ndarray, rows: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in the lanes of the words, and their rows; those of a short document are its whole sequence."""
    counts = np.bincount(rows, minlength=n)
    at = np.cumsum(counts) - counts
    whole = window_digests(words, width)
    inside = rows[: whole.shape[1]] == rows[width - 1 :] if whole.shape[1] else np.zeros(0, bool)
    values, owner = [whole[:, inside]], [rows[: whole.shape[1]][inside]]
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            values.append(window_digests(words, size)[:, at[short]])
            owner.append(short)
    return np.concatenate(values, axis=1), np.concatenate(owner)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(values, offsets, number of words, class): the distinct shingles of each row, sorted within the row.

    The class is a 128-bit digest of the set. That of a small set takes in both lanes of its shingles; larger sets that
    differed in shingles with equal first lanes would be linked in any case.
    """
    words, rows = words_of(texts, lower=True)
    n = len(texts)
    values, owner = _shingles(words[:1], rows, n, width)
    values = values[0]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    offsets = row_starts(owner, n)
    sizes = np.diff(offsets)
    few = np.flatnonzero((sizes > 0) & (sizes <= SMALL))
    extra = dict.fromkeys(few.tolist(), b"")
    if len(few):
        use = np.isin(rows, few)
        second, owner = _shingles(words[1:, use], rows[use], n, width)
        pairs = np.unique(np.column_stack([owner.astype(np.uint64), second[0]]), axis=0)
        ends = row_starts(pairs[:, 0].astype(np.int64), n)
        extra = {i: pairs[ends[i] : ends[i + 1], 1].tobytes() for i in few.tolist()}
    data, bounds = values.tobytes(), (8 * offsets).tolist()
    classes = [digest(data[a:b] + extra.get(i, b"")) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    return values, offsets, np.bincount(rows, minlength=n), classes


def short_ids(ids: list[bytes]) -> np.ndarray:
    """48 bits of each class digest, for candidates only: classes that share them are all looked at."""
    return np.frombuffer(b"".join(ids), np.uint64)[::2] & SHORT if ids else np.zeros(0, np.uint64)


def _cut(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of each number."""
    return x.view(np.uint8).reshape(-1, 8)[:, :size]


def _uncut(data: list[bytes], size: int) -> np.ndarray:
    return np.pad(np.frombuffer(b"".join(data), np.uint8).reshape(-1, size), ((0, 0), (0, 8 - size))).view(np.uint64).ravel()


def prefix_size(sizes: np.ndarray) -> np.ndarray:
    """Shingles of a set's prefix: those that may be missing in a linked set, and a tenth of all."""
    return np.minimum(sizes, sizes - -(-3 * sizes // 4) + sizes // 10 + 1)


def prefix_need(sizes: np.ndarray) -> np.ndarray:
    """Shingles that the prefixes of a set and a linked one share, at least; the linked one may be smaller by a quarter."""
    return -(-3 * sizes // 4) // 10 + 1


def bands(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band of each size, [2**m, 2**(m+1)), and whether partners may lie in the next band."""
    m = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    return m, 4 * sizes >= 3 * (1 << (m + 1))


def scheme(band: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of a band: parts, cells of a part, and cells in which a part may differ; n1 0: only equal sets link."""
    largest = (1 << (band + 1)) - 1
    differ = 2 * largest // 7
    if differ < 1:
        return 0, 0, 0
    n2, k2 = (5, 2) if largest < 32 else (3, 1)
    worse = differ // (k2 + 1)  # parts that can differ in more cells
    return worse + 1 + worse // 8, n2, k2


def least_shared(differ: np.ndarray, n1: int, n2: int, k2: int) -> np.ndarray:
    """Subsets on which sets agree that differ in so many elements, at least, empty ones included."""
    agree = [math.comb(n2 - d, n2 - k2) if d <= k2 else 0 for d in range(k2 + 2)]
    left, out = differ.copy(), np.full(len(differ), n1 * agree[0])
    for d in range(k2 + 1):  # one more difference in a part spoils less and less of its subsets
        spent = np.minimum(left, n1)
        out, left = out - spent * (agree[d] - agree[d + 1]), left - spent
    return out


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, row, kind, need) of each row's set, under its own band (kind 0), the next (1) and later divisions (2).

    A linked set shares at least ``need`` of the signatures of this kind and band.
    """
    sizes = np.diff(offsets)
    own, next_too = bands(sizes)
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for ahead in (0, 1):
        rows = np.flatnonzero((sizes >= 3) & (next_too if ahead else True))
        for band in np.unique(own[rows] + ahead).tolist():
            found += _band_signatures(values, offsets, rows[own[rows] + ahead == band], band, ahead)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _band_signatures(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, band: int, ahead: int) -> list[tuple[np.ndarray, ...]]:
    n1, n2, k2 = scheme(band)
    out = []
    for division in range(DIVISIONS if n1 else 0):
        if not len(rows):
            return out
        sizes = offsets[rows + 1] - offsets[rows]
        ends = np.cumsum(sizes)
        element = np.repeat(offsets[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
        owner = np.repeat(np.arange(len(rows)), sizes)
        hashed = mix(values[element] ^ np.uint64(0xA5A5A5A5 + 7919 * division))
        cell = owner * (n1 * n2) + (hashed % np.uint64(n1 * n2)).astype(np.int64)
        content, filled = np.zeros(len(rows) * n1 * n2, np.uint64), np.zeros(len(rows) * n1 * n2, bool)
        np.add.at(content, cell, mix(hashed + np.uint64(7)))
        filled[cell] = True
        content, filled = content.reshape(-1, n2), filled.reshape(-1, n2)
        part = np.arange(len(content))
        label = np.uint64(band * 1_000_003 + division) + (part % n1).astype(np.uint64) * np.uint64(1 << 32)
        signed_subsets, empty = [], np.zeros(len(rows), np.int64)
        for i, subset in enumerate(combinations(range(n2), n2 - k2)):
            some = filled[:, subset].any(axis=1)
            empty += (~some).reshape(-1, n1).sum(axis=1)
            sums = content[some][:, subset].sum(axis=1, dtype=np.uint64)
            signed_subsets.append((mix(sums ^ mix(label[some] * np.uint64(16) + np.uint64(i))), part[some] // n1))
        largest = np.minimum(4 * sizes // 3, (1 << (band + 1)) - 1)
        need = least_shared((sizes + largest) // 7, n1, n2, k2) - empty
        asked = np.maximum(need, 1) if division == 0 else np.ones(len(rows), np.int64)
        for sig, i in signed_subsets:
            out.append((sig, rows[i], np.full(len(i), 2 if division else ahead), asked[i]))
        rows = rows[need < 1]
    if n1 and len(rows):  # no division fills enough cells: linked sets share an element at least, so each one signs
        sizes = offsets[rows + 1] - offsets[rows]
        ends = np.cumsum(sizes)
        element = np.repeat(offsets[rows] - (ends - sizes), sizes) + np.arange(ends[-1])
        owner = np.repeat(rows, sizes)
        out.append((mix(values[element] ^ np.uint64(band * 1_000_003 + DIVISIONS)), owner, np.full(len(owner), 2), np.ones(len(owner), np.int64)))
    return out


def set_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, n_shingles, cls, short, prefix) for every document; a task gives the prefix of a class once."""
    names = ["key", "n_words", "n_shingles", "cls", "short", "prefix"]
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # classes of this task; some hundred bytes for each of its documents
        for batch in text_chunks(batches):
            values, offsets, words, ids = shingle_sets(batch.column(1))
            sizes = np.diff(offsets)
            ends = offsets[:-1] + prefix_size(sizes)
            prefixes = []
            for c, start, end in zip(ids, offsets[:-1].tolist(), ends.tolist(), strict=True):
                prefixes.append(None if c in seen or start == end else _cut(values[start:end] >> np.uint64(8), 7).tobytes())
                seen.add(c)
            columns = [pa.array(words.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(ids, pa.binary()), pa.array(signed(short_ids(ids)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(prefixes, pa.binary())], names=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {key_type}, n_words long, n_shingles long, cls binary, short long, prefix binary")


def _buckets_of(entries: int) -> int:
    return max(64, entries * 13 // BUCKET_BYTES)


def _spread(entries: np.ndarray, cls: np.ndarray, buckets: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Entries that meet by value, in buckets that are ranges of it, and the places of the others.

    ``entries`` are sorted, values below BARE with marks above. The first of the classes of a batch that share a value
    stands for them, marked SHARED; the others are known to share it.
    """
    bare = entries & BARE
    first = np.diff(bare, prepend=~bare[:1]) != 0
    group = np.diff(np.append(np.flatnonzero(first), len(bare)))
    entries = entries | np.where(np.repeat(group, group) > 1, SHARED, 0).astype(np.uint64)
    width = (BARE + np.uint64(1)) // np.uint64(buckets) + np.uint64(1)
    return _in_buckets((bare // width)[first], entries[first], cls[first]), np.flatnonzero(~first)


def _meeting(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(entries, classes) that several classes share, and those marked KNOWN, of the packed rows of a bucket; equal entries once."""
    sig, cls = _uncut(table.column("sig").to_pylist(), 7), _uncut(table.column("cls").to_pylist(), 6)
    order = np.lexsort((cls, sig & ~SHARED))
    sig, cls = sig[order], cls[order]
    plain = sig & ~SHARED
    new = np.ones(len(sig), bool)
    new[1:] = (plain[1:] != plain[:-1]) | (cls[1:] != cls[:-1])
    marked = np.logical_or.reduceat(sig & SHARED > 0, np.flatnonzero(new)) if len(sig) else new
    plain, cls = plain[new], cls[new]
    apart = plain & KNOWN > 0
    bare = np.where(apart, np.arange(len(plain), dtype=np.uint64) | KNOWN, plain & BARE)
    order = np.argsort(bare, kind="stable")
    at = np.flatnonzero(np.diff(bare[order], prepend=~bare[order][:1]))
    keep = np.zeros(len(plain), bool)
    if len(at):
        group = np.diff(np.append(at, len(plain)))
        keep[order] = np.repeat(np.logical_or.reduceat(marked[order], at) | (group > 1), group)
    keep |= apart
    return plain[keep], cls[keep]


def shared_prefixes(prefixes: DataFrame, buckets: int) -> DataFrame:
    """(short, n): how many shingles of a class's prefix occur in prefixes of other classes, in parts. n can be too large."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # prefixes are the smallest values of sets: mixed, they fill all buckets alike
            values = mix(_uncut(batch.column(1).to_pylist(), 7)) & BARE
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 7
            cls = np.repeat(batch.column(0).to_numpy().view(np.uint64), sizes)
            order = np.argsort(values)
            met, others = _spread(values[order], cls[order], buckets)
            yield met
            which, counts = np.unique(cls[order][others], return_counts=True)
            apart = counts.astype(np.uint64) | KNOWN
            bucket = mix(which) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            yield _in_buckets(bucket[order], apart[order], which[order])

    def meet(table: pa.Table) -> pa.Table:
        sig, cls = _meeting(table)
        counts = np.where(sig & KNOWN > 0, sig & BARE, np.uint64(1)).astype(np.int64)
        which, at = np.unique(cls, return_inverse=True)
        return pa.table({"short": signed(which), "n": np.bincount(at, counts, len(which)).astype(np.int64)})

    packed = prefixes.mapInArrow(pack, "bucket long, sig binary, cls binary")
    return packed.groupBy("bucket").applyInArrow(meet, "short long, n long")


def packed_entries(sig: np.ndarray, cls: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sig, cls) of a batch of entries: marked signatures (56 bits) and the short ids that hold them."""
    order = np.argsort(sig & BARE)
    sig, cls = sig[order], cls[order]
    met, others = _spread(sig, cls, buckets)
    yield met
    yield scattered(sig[others] | KNOWN, cls[others], buckets)


def scattered(sig: np.ndarray, cls: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of entries that need not meet others: what is known to be shared, and needs."""
    bucket = mix(cls ^ sig) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return _in_buckets(bucket[order], sig[order], cls[order])


def meeting_entries(packed: DataFrame) -> DataFrame:
    """(sig, short, kind, need) of the signatures that at least two classes have, and rows without ``sig`` that alone hold the needs."""

    def meet(table: pa.Table) -> pa.Table:
        sig, cls = _meeting(table)
        kind, bare = ((sig >> KIND) & np.uint64(3)).astype(np.int32), sig & BARE
        asked = kind == 3
        need = (bare >> np.uint64(2)).astype(np.int32)
        kind = np.where(asked, bare & np.uint64(3), kind).astype(np.int32)
        return pa.table({"sig": pa.array(signed(bare), mask=asked), "short": signed(cls), "kind": kind, "need": pa.array(need, mask=~asked)})

    return packed.groupBy("bucket").applyInArrow(meet, "sig long, short long, kind int, need int")


ENTRIES = "bucket long, sig binary, cls binary"


def shared_signatures(sets: DataFrame, buckets: int) -> DataFrame:
    """``meeting_entries`` of all signatures of ``sets`` (short, shingles), which has one row a class."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "shingles", fill=False, size=2 * PACK_BYTES):
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            offsets = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 8)])
            short = batch.column(0).to_numpy().view(np.uint64)
            sig, owner, kind, need = signatures(values, offsets)
            yield from packed_entries(sig & BARE | kind.astype(np.uint64) << KIND, short[owner], buckets)
            asked = np.unique(np.column_stack([owner, kind, need]), axis=0).astype(np.uint64)
            needs = np.minimum(asked[:, 2], BARE >> np.uint64(2)) << np.uint64(2) | asked[:, 1] | np.uint64(3) << KIND | KNOWN
            yield scattered(needs, short[asked[:, 0].astype(np.int64)], buckets)

    return meeting_entries(sets.select("short", "shingles").mapInArrow(pack, ENTRIES))


def _in_buckets(bucket: np.ndarray, sig: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, of entries sorted by bucket."""
    which, starts = np.unique(bucket, return_index=True)
    spans = list(zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=False))
    columns = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (_cut(sig, 7), _cut(cls, 6))]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), *columns], names=["bucket", "sig", "cls"])


def rarest_signatures(shared: DataFrame) -> DataFrame:
    """(sig, short): for each class with enough shared signatures, the rarest ones, all but ``need - 1``.

    Classes that share a short id are taken as one; the smallest of their needs counts, so that none loses a signature.
    """
    often = shared.where("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("freq"))
    return (
        shared.join(often, "sig", "left")
        .groupBy("short", "kind")
        # at most the document's own signatures
        .agg(F.coalesce(F.min("need"), F.lit(1)).alias("need"), F.sort_array(F.collect_list(F.when(F.col("sig").isNotNull(), F.struct("freq", "sig")))).alias("sigs"))
        .where(F.size("sigs") >= F.col("need"))
        .select("short", F.explode(F.slice("sigs", F.lit(1), F.size("sigs") - F.col("need") + 1)).alias("s"))
        .select(F.col("s.sig").alias("sig"), "short")
    )


#: Tells which of some sets may be linked with one: (its sketch, their sketches, its size, their sizes).
Estimate = Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]


def forest(
    sets: list[np.ndarray], roots: list, pivots: list[bool] | None = None, percent: int = 75, sketches: np.ndarray | None = None, estimate: Estimate | None = None
) -> list[tuple[int, int]]:
    """Links that span the link graph of some sets, those with equal roots being linked already.

    Breadth first, each set compared with sets not yet reached. With ``pivots``, these alone are compared with the others.
    With ``sketches``, only sets that the ``estimate`` does not rule out are compared element by element.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    root = np.unique(np.array(roots, object).astype(str), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    own = lambda i: codes[ends[i] - sizes[i] : ends[i]]
    left, flat, mark = np.arange(len(sets)), codes, np.zeros(int(codes.max(initial=-1)) + 1, bool)
    out, queue = [], []
    starts = None if pivots is None else [i for i, p in enumerate(pivots) if p]

    def without(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return flat if estimate else flat[np.repeat(~gone, sizes[left])], left[~gone]

    def common_of(pivot: int) -> np.ndarray:
        """Elements that each set left has in common with one; -1 where the estimate rules a link out."""
        out, maybe, of = np.full(len(left), -1), np.arange(len(left)), flat
        if estimate:
            maybe = np.flatnonzero(estimate(sketches[pivot], sketches[left], int(sizes[pivot]), sizes[left]))
            n = sizes[left[maybe]]
            last = np.cumsum(n)
            of = codes[np.repeat(ends[left[maybe]] - last, n) + np.arange(last[-1] if len(last) else 0)]
        mark[own(pivot)] = True
        hits = np.concatenate([[0], np.cumsum(mark[of])])
        mark[own(pivot)] = False
        bounds = np.concatenate([[0], np.cumsum(sizes[left[maybe]])])
        out[maybe] = hits[bounds[1:]] - hits[bounds[:-1]]
        return out

    while len(left) or queue:
        if not queue:
            if starts is not None and not starts:
                break
            i = int(left[0]) if starts is None else starts.pop()
            queue.append(i)
            flat, left = without(left == i)
        if not len(left):
            break
        pivot = queue.pop()
        common = common_of(pivot)
        known = root[left] == root[pivot]
        found = (common >= 0) & linked(common, sizes[pivot], sizes[left], percent) | known
        if found.any():
            out += [(pivot, r) for r in left[found & ~known].tolist()]
            if starts is None:
                queue += left[found].tolist()
            flat, left = without(found)
    return out


LINKS = "a binary, b binary"


def links_of(rows: DataFrame, by: list[str], pivots: bool, percent: int = 75, sketch: Callable | None = None, estimate: Estimate | None = None) -> DataFrame:
    """(a, b) links between classes within groups of (*by, cls, root, pivot, shingles) rows; ``sketch`` makes the matrix of what ``estimate`` takes."""

    def run(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        found = forest(sets, table.column("root").to_pylist(), table.column("pivot").to_pylist() if pivots else None, percent, sketch(sets) if sketch else None, estimate)
        return pa.table({"a": pa.array([cls[i] for i, _ in found], pa.binary()), "b": pa.array([cls[j] for _, j in found], pa.binary())})

    return rows.groupBy(*by).applyInArrow(run, LINKS)


def with_classes(docs: DataFrame, text: str, shingles: bool = False, width: int = WIDTH) -> DataFrame:
    """Adds ``jaccard_cls`` and ``jaccard_size``, class and size of each document's set; with ``shingles`` these, in place of the text."""
    kept = [c for c in docs.columns if not (shingles and c == text)]
    added = [T.StructField("jaccard_cls", T.BinaryType()), T.StructField("jaccard_size", T.LongType())] + [T.StructField("jaccard_set", T.BinaryType())] * shingles
    marked = T.StructType([*[docs.schema[c] for c in kept], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, fill=False):
            column = batch.column(batch.schema.get_field_index(text))
            values, offsets, _, ids = shingle_sets(column.fill_null(""), width)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns = [c.cast(pa.string()) if c.type == pa.large_string() else c for c in columns]
            columns += [pa.array(ids, pa.binary()), pa.array(np.diff(offsets).astype(np.int64))]
            if shingles:
                columns.append(pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(marked, columns, strict=True)]))

    return docs.mapInArrow(run, marked)


def of_classes(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Rows of ``with_classes`` that stand for a class of (cls, rep), with its columns.

    Joined by key and class: keys may be null or repeated, and copies of one text do not meet in one task. Classes grow
    with the input, so the plan is the same merge join at every size.
    """
    both = lambda a, b: F.xxhash64(a, b).alias("jaccard_key")
    classes = classes.select("*", both("rep", "cls")).hint("merge")
    found = rows.where("jaccard_size > 0").select("*", both(key, "jaccard_cls")).join(classes, "jaccard_key")
    return found.where(F.col(key).eqNullSafe(F.col("rep")) & (F.col("jaccard_cls") == F.col("cls")))


def _blocks(total: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sum(total) / BLOCK_FEATURES)).cast("int")


def class_links(docs: DataFrame, base: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) links that span each component of classes; docs (key, text), base as of ``set_rows``, classes (cls, short, rep, n_shingles)."""
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    met = shared_prefixes(base.where("prefix is not null").select("short", "prefix"), _buckets_of(int(0.36 * total)))
    met = met.groupBy("short").agg(F.sum("n").alias("met"))
    need = F.floor(F.ceil(F.col("n_shingles") * 3 / 4) / 10) + 1
    wanted = written(classes.join(met, "short").where(F.col("met") >= need).select("cls", "short", "rep", "n_shingles"), "jaccard-wanted")
    total = wanted.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    sets = written(sets_of(docs, wanted), "jaccard-sets")
    met = written(shared_signatures(sets, _buckets_of(int(0.7 * total))), "jaccard-met")
    shared = written(rarest_signatures(met), "jaccard-shared")
    drop_written(met)
    links = candidate_links(sets, shared)
    for df in (shared, sets, wanted):
        drop_written(df)
    return links


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(cls, short, n, shingles) of the classes ``wanted`` (cls, short, rep): the set of the document that stands for each.

    Texts are joined by key before they are cut into shingles, so only those of wanted keys are; a key can be null or
    repeated, hence the class is compared behind. Classes grow with the input: the plan is the same merge join at every size.
    """
    by_key = wanted.select("cls", "short", "rep", F.xxhash64("rep").alias("place")).hint("merge")
    texts = docs.select("key", "text", F.xxhash64("key").alias("place")).join(by_key, "place").where(F.col("key").eqNullSafe(F.col("rep")))
    texts = texts.dropDuplicates(["place", "key", "cls", "text"]).select("cls", "short", "text")
    found = with_classes(texts, "text", shingles=True, width=width).where(F.col("jaccard_cls") == F.col("cls"))
    return found.select("cls", "short", F.col("jaccard_size").alias("n"), F.col("jaccard_set").alias("shingles"))


def candidate_links(sets: DataFrame, shared: DataFrame, percent: int = 75, sketch: Callable | None = None, estimate: Estimate | None = None) -> DataFrame:
    """(a, b) links that span each component of ``sets`` (cls, short, n, shingles) whose linked members share a value of ``shared`` (sig, short)."""
    centres = shared.groupBy("sig").agg(F.min("short").alias("centre"), F.max("short").alias("most")).where("centre <> most").drop("most")
    met = shared.join(centres, "sig")
    stars = written(met.groupBy("short").agg(F.min(F.when(F.col("short") != F.col("centre"), F.col("centre"))).alias("centre")), "jaccard-stars")
    stars = stars.where("centre is not null")
    members = sets.join(stars, "short").select("centre", "cls", "n", "shingles")
    parts = written(sets.select("short", "n").join(stars, "short").groupBy("centre").agg(_blocks("n").alias("parts")), "jaccard-parts")
    rows = members.join(parts, "centre").select("centre", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"), "cls", F.lit(False).alias("pivot"), "shingles")
    middle = sets.join(parts, F.col("short") == F.col("centre")).select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cls", F.lit(True).alias("pivot"), "shingles"
    )
    rows = rows.unionByName(middle).withColumn("root", F.hex("cls"))
    first = written(links_of(rows, ["centre", "part"], True, percent, sketch, estimate), "jaccard-star-links")
    # what is left: signatures whose classes have several roots
    roots = components(first, "jaccard-roots")
    rooted = sets.select("cls", "short").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "short", F.coalesce("root", "cls").alias("root"))
    rooted = shared.join(rooted, "short").select("sig", "cls", "root")
    open_ = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("cls").alias("a")).where("low <> high")
    edges = rooted.join(open_.select("sig", "a"), "sig").select("a", F.col("cls").alias("b"), "root")
    edges = written(edges.distinct(), "jaccard-open")
    groups = components(edges.select("a", "b"), "jaccard-groups").select(F.col("node").alias("cls"), F.col("root").alias("group"))
    groups = groups.join(edges.select(F.col("b").alias("cls"), "root").distinct(), "cls")
    sized = sets.select("cls", "n", "shingles").join(groups, "cls")
    blocks = written(groups.join(sets.select("cls", "n"), "cls").groupBy("group").agg(_blocks("n").alias("blocks")), "jaccard-blocks")
    rows = (
        sized.join(blocks, "group")
        .withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("mine", "other").alias("left_block"), F.greatest("mine", "other").alias("right_block"), "cls", F.hex("root").alias("root"), F.lit(False).alias("pivot"), "shingles")
    )
    second = links_of(rows, ["group", "left_block", "right_block"], False, percent, sketch, estimate)
    links = written(first.unionByName(second), "jaccard-links")
    for df in (stars, parts, first, edges, blocks):
        drop_written(df)
    return links


def classes_of(base: DataFrame) -> DataFrame:
    """(cls, rep, n_class, n_shingles, short) of the rows of documents that have words; ``rep`` is the smallest key."""
    return base.where("n_shingles > 0").groupBy("cls").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("n_class"), F.first("n_shingles").alias("n_shingles"), F.first("short").alias("short")
    )


def named_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, rep, n_class, component, first): ``component`` is the smallest key that a class is linked with; one class of a component is its ``first``."""
    roots = components(links, "jaccard")
    named = classes.select("cls", "rep", "n_class").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    order = F.struct(F.col("rep").isNull(), "rep", "cls")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"), F.min_by("cls", order).alias("first_cls"))
    return named.join(smallest, "root").select("cls", "rep", "n_class", "component", (F.col("cls") == F.col("first_cls")).alias("first"))


def with_components(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of ``base`` with the size of its class and its component, its own key if it has no words."""
    classes = classes.select(F.col("cls").alias("c"), "n_class", "component")
    found = base.join(classes, (F.col("cls") == F.col("c")) & (F.col("n_shingles") > 0), "left")
    return found.withColumn("component", F.coalesce("component", "key"))


def duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of ``set_rows`` for every document, and the ``named_classes``."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    base = written(set_rows(docs, "key", "text"), "jaccard-base")
    classes = written(classes_of(base), "jaccard-classes")
    return base, written(named_classes(classes, class_links(docs, base, classes)), "jaccard-components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_shingles, n_class, component) for every document."""
    base, classes = duplicate_classes(docs, key, text)
    return with_components(base, classes).select("key", "n_words", "n_shingles", "n_class", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest key (of equal rows one), and all documents without words."""
    columns = docs.columns
    plain = docs.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)])  # no name of the input can clash with those added
    key, text = (f"kept_{columns.index(c)}" for c in (key, text))
    _, classes = duplicate_classes(plain, key, text)
    first = classes.where("first").select("cls", "rep")
    rows = with_classes(plain, text)
    kept = of_classes(rows, first, key)
    turn = F.row_number().over(W.partitionBy("jaccard_key", "rep", "cls").orderBy("jaccard_key"))
    kept = kept.withColumn("jaccard_turn", turn).where("jaccard_turn = 1")
    out = kept.select(*plain.columns).unionByName(rows.where("jaccard_size = 0").select(*plain.columns))
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_duplicates(docs).select(
        F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_copies")
    )


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS g FROM
    (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, n, md5(string_agg(g, '' ORDER BY g)) AS c FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
rep AS (SELECT c, min(doc_id) AS rep, count(*) AS copies FROM cls GROUP BY c),
r AS (SELECT s.doc_id, s.g, n.n FROM s JOIN rep ON s.doc_id = rep.rep JOIN n ON n.doc_id = s.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
t(v, u) AS (SELECT rep, rep FROM rep UNION SELECT t.v, e.y FROM t JOIN e ON t.u = e.x),
k AS (SELECT v, min(u) AS component FROM t GROUP BY v)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k.component, w.doc_id) AS component_id,
  coalesce(rep.copies, 1)::BIGINT AS n_copies
FROM w LEFT JOIN cls ON w.doc_id = cls.doc_id LEFT JOIN rep ON cls.c = rep.c LEFT JOIN k ON k.v = rep.rep
"""
