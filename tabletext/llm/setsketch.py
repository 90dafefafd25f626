"""MinHash near-duplicates by SetSketch registers: bands of register values meet, a likelihood estimates, whole sets decide.

Documents are sets of word 3-grams. A register is the smallest of the exponential arrival times of all elements at it, rounded
to a power of ``BASE`` and held within 16 bits, so the registers of a union are the larger ones of its parts' (``merged``).
Elements arrive as Poisson processes: each draws growing times, each time at a random register, until no register of its
set can be beaten any more; large sets so cost little more than one draw an element.

The values of ``ROWS`` registers make one of ``BANDS`` signatures. Two sets of Jaccard similarity 0.85 agree in a register with
a chance of 0.85 at least, so they share no signature with a chance of (1 - 0.85**8)**64 = 1e-9. Where classes share one,
registers larger in one set, in the other, and equal are counted, and the joint likelihood of the counts, given the sizes,
is taken at its peak and at the threshold: pairs ``SURE`` times likelier below it are left, all others are confirmed on whole
sets. Equal sets are one class before anything is signed; sets of fewer than six elements link with equal ones only.

Candidates, centres, contraction and blocks are those of ``jaccard.candidate_links``: no pair list, no hot key in one task.

Edge cases: a null or empty text has an empty set and links with nothing; fewer than three words make one element; a null
key is kept (its component is the smallest key of its class, null if there is none) and is not ``kept``; repeated rows are
classmates; an empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.llm.common import drop_written, mix, read, signed, text_chunks, written
from tabletext.llm.jaccard import (
    BARE,
    BUCKET_BYTES,
    ENTRIES,
    _cut,
    _uncut,
    candidate_links,
    classes_of,
    meeting_entries,
    named_classes,
    packed_entries,
    sets_of,
    shingle_sets,
    short_ids,
    with_components,
)

WIDTH, PERCENT = 3, 85
BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
#: Base of the exponential spacing, rate of arrivals at a register, and largest register value.
BASE, RATE, TOP = 1.02, 20.0, (1 << 16) - 1
#: Log of how much likelier than the threshold a smaller similarity must be to leave a pair: a chance of 1e-10 at the threshold.
SURE = 20.0
#: Draws and sets worked on at once.
DRAWS, SLICE = 2_000_000, 2000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _arrivals(elements: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps between the draws ``start`` to ``start + n`` of each element, and the registers that they come to."""
    turns = (np.arange(start + 1, start + n + 1, dtype=np.uint64) * _STEP)[None, :]
    drawn = mix(mix(elements ^ np.uint64(0x5E75CE7C4))[:, None] + turns)
    gaps = -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS * RATE)
    return gaps, (drawn & np.uint64(REGISTERS - 1)).astype(np.int64)


def first_arrivals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The time at which the first element of each set comes to each register (sets x registers)."""
    sizes = np.diff(offsets)
    first = np.full((len(sizes), REGISTERS), np.inf)
    flat = first.ravel()
    level = np.frexp(np.maximum(sizes, 1))[1]
    for at in np.unique(level).tolist():
        # draws after which nearly all registers of the smallest set of this level are reached
        some = int(REGISTERS * (np.log(REGISTERS) + 1) / (1 << (at - 1))) + 2
        rows = np.flatnonzero((level == at) & (sizes > 0))
        per = max(1, DRAWS // (some << at))
        for k in range(0, len(rows), per):
            own = rows[k : k + per]
            n = sizes[own]
            ends = np.cumsum(n)
            element = values[np.repeat(offsets[own] - (ends - n), n) + np.arange(ends[-1])]
            owner = np.repeat(own, n)
            time, start, turns = np.zeros(len(element)), 0, some
            while len(element):
                width = max(1, min(turns, DRAWS // len(element)))
                gaps, register = _arrivals(element, start, width)
                times = time[:, None] + np.cumsum(gaps, axis=1)
                np.minimum.at(flat, (owner[:, None] * REGISTERS + register).ravel(), times.ravel())
                time, start, turns = times[:, -1], start + width, max(2, some // 4)
                active = time < first[owner].max(axis=1) if len(element) < 5000 else time < first[own].max(axis=1)[np.searchsorted(own, owner)]
                element, owner, time = element[active], owner[active], time[active]
    return first


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each set: first arrivals in steps of ``BASE``, earlier ones larger, held between 0 and ``TOP``; an empty set has zeros."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    for at in range(0, len(out), SLICE):  # arrival times are four times as large as registers
        own = offsets[at : at + SLICE + 1]
        with np.errstate(divide="ignore"):
            steps = np.floor(1 - np.log(first_arrivals(values[own[0] : own[-1]], own - own[0])) / np.log(BASE))
        out[at : at + SLICE] = np.clip(steps, 0, TOP)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the unions of the sets of a and b."""
    return np.maximum(a, b)


def band_values(sketch: np.ndarray) -> np.ndarray:
    """A signature of 52 bits for each band (sets x bands)."""
    words = np.ascontiguousarray(sketch).view(np.uint64).reshape(len(sketch), BANDS, ROWS // 4)
    out = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)[None, :]
    for k in range(words.shape[2]):
        out = mix(out * np.uint64(3) + words[:, :, k])
    return out & BARE


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the one set are larger, smaller, and equal; u is its share of both sizes."""
    step = (BASE - 1) / BASE
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * step) / np.log(BASE)
    p, q = chance(u - (1 - u) * j), chance(1 - u - u * j)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def likeliest(more: np.ndarray, less: np.ndarray, same: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by ternary search (the likelihood is concave)."""
    u = a / (a + b)
    low, high = np.zeros(len(b)), np.minimum(a, b) / np.maximum(a, b)
    for _ in range(30):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(left, more, less, same, u) < log_likelihood(right, more, less, same, u)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def may_link(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """False where sizes, or the joint likelihood of the registers, rule out that sets are linked with one."""
    fits = 100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size)
    at = np.flatnonzero(fits)
    if len(at):
        x, n = others[at], sizes[at]
        more, less = (one > x).sum(axis=1), (one < x).sum(axis=1)
        same, u = REGISTERS - more - less, size / (size + n)
        best, bound = likeliest(more, less, same, size, n), np.full(len(at), PERCENT / 100)
        gain = log_likelihood(best, more, less, same, u) - log_likelihood(bound, more, less, same, u)
        fits[at] = (best >= bound) | (gain <= SURE)
    return fits


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    return registers(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64))


def sketched_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, cls, short, bands) for every document; a task gives the band signatures of a class once."""
    names = ["key", "n_shingles", "cls", "short", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # classes of this task; some hundred bytes for each of its documents
        for batch in text_chunks(batches):
            values, offsets, _, ids = shingle_sets(batch.column(1), WIDTH)
            sizes = np.diff(offsets)
            new = []
            for i, c in enumerate(ids):
                if 100 * sizes[i] >= PERCENT * (sizes[i] + 1) and c not in seen:  # large enough to link with another set
                    new.append(i)
                seen.add(c)
            bands: list[bytes | None] = [None] * len(ids)
            for i, row in zip(new, band_values(sketches_of([values[offsets[i] : offsets[i + 1]] for i in new])), strict=True):
                bands[i] = _cut(row, 7).tobytes()
            columns = [pa.array(sizes.astype(np.int64)), pa.array(ids, pa.binary()), pa.array(signed(short_ids(ids))), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_shingles long, cls binary, short long, bands binary")


def shared_bands(rows: DataFrame, buckets: int) -> DataFrame:
    """(sig, short) of the band signatures that several classes have."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column(0).to_numpy().view(np.uint64)
            yield from packed_entries(_uncut(batch.column(1).to_pylist(), 7), np.repeat(short, BANDS), buckets)

    return meeting_entries(rows.mapInArrow(pack, ENTRIES)).select("sig", "short")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, n_class, component) for every document."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    base = written(sketched_rows(docs, "key", "text"), "setsketch-base")
    classes = written(classes_of(base), "setsketch-classes")
    signing = base.where("bands is not null").select("short", "bands")
    buckets = max(64, signing.count() * BANDS * 13 // BUCKET_BYTES)
    shared = written(shared_bands(signing, buckets), "setsketch-shared")
    wanted = written(classes.join(shared.select("short").distinct(), "short").select("cls", "short", "rep"), "setsketch-wanted")
    sets = written(sets_of(docs, wanted, WIDTH), "setsketch-sets")
    links = candidate_links(sets, shared, PERCENT, sketches_of, may_link)
    found = written(named_classes(classes, links), "setsketch-components")
    for df in (shared, wanted, sets, classes, links):
        drop_written(df)
    return with_components(base, found).select("key", "n_shingles", "n_class", "component")


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document, and which document of each class is kept."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("key") == F.col("component"), F.lit(False))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 2], ' ')) AS g FROM
    (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, n, md5(string_agg(g, '' ORDER BY g)) AS c FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
rep AS (SELECT c, min(doc_id) AS rep FROM cls GROUP BY c),
r AS (SELECT s.doc_id, s.g, n.n FROM s JOIN rep ON s.doc_id = rep.rep JOIN n ON n.doc_id = s.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
t(v, u) AS (SELECT rep, rep FROM rep UNION SELECT t.v, e.y FROM t JOIN e ON t.u = e.x),
k AS (SELECT v, min(u) AS component FROM t GROUP BY v)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k.component, w.doc_id) AS component_id,
  w.doc_id = coalesce(k.component, w.doc_id) AS kept
FROM w LEFT JOIN cls ON w.doc_id = cls.doc_id LEFT JOIN rep ON cls.c = rep.c LEFT JOIN k ON k.v = rep.rep
"""
