"""Helpers of the training-data operators: table access, shared scratch tables, word arrays."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once inside a task. A longer document is worked on whole, alone.
CHUNK_BYTES = 500_000


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults (10,000 rows, 64 MB).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits from their defaults: whole texts are long rows, and every task holds a batch or two."""
    prefix = "spark.sql.execution.arrow."
    if spark.conf.get(f"{prefix}maxRecordsPerBatch") == "10000":
        spark.conf.set(f"{prefix}maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set(f"{prefix}maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's scratch tables, in the one that driver and executors share.

    Where the session names none, a local folder serves if the master is local too; on a cluster that is an error.
    """
    bounded_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"{tempfile.gettempdir()}/tabletext-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing will read it again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result that reads them is wanted any more."""
    _delete(spark, shared_dir(spark))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES, fill: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold at most ``size`` bytes (or are one row). ``fill``: null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        texts = texts if pa.types.is_binary(texts.type) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "") if fill else texts
        batch = pa.RecordBatch.from_arrays(
            [texts if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names
        )
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the n+1 offsets of its rows."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- digests of words and of ranges of words: two lanes of 61 bits each

#: A prime modulus: unlike modulo a power of two, no regular sequence of words (as that of Thue and Morse) makes a polynomial vanish.
PRIME = np.uint64((1 << 61) - 1)
_BASES = (0x0E5B1C2F7A9D3341, 0x13D4A6B8925C7E0B)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[list[np.ndarray]] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle = ah * bl + al * bh
    return _reduced(((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + al * bl)


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME, from 0."""
    out = np.zeros(len(x) + 1, np.uint64)
    high = _reduced(np.cumsum(x >> np.uint64(32)))
    out[1:] = _reduced(times(high, np.uint64(1 << 32)) + _reduced(np.cumsum(x & np.uint64(0xFFFFFFFF))))
    return out


def _powers(n: int) -> list[list[np.ndarray]]:
    """For each lane, the first n powers of its base and of the base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, CHUNK_BYTES // 4)
        made = []
        for base in _BASES:
            lane = []
            for b in (base, pow(base, -1, int(PRIME))):
                run, step = np.ones(1, np.uint64), b
                while len(run) < size:
                    run, step = np.concatenate([run, times(run, np.uint64(step))]), step * step % int(PRIME)
                lane.append(run[:size])
            made.append(lane)
        _POWERS[:] = made
    return [[p[:n] for p in lane] for lane in _POWERS]


class Ranges:
    """128-bit digests (two lanes of an array) of any ranges of a sequence of names, which are two lanes themselves."""

    def __init__(self, names: np.ndarray):
        powers = _powers(names.shape[1] + 1)
        self.down = [p[1] for p in powers]
        self.total = [_sums(times(lane % PRIME, p[0][:-1])) for lane, p in zip(names, powers, strict=True)]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64) * _STEP
        return np.stack([mix(times(_reduced(t[end] + PRIME - t[start]), d[start]) + size) for t, d in zip(self.total, self.down, strict=True)])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not white space (32, 9 to 13)."""
    return run_spans((data != 32) & ((data < 9) | (data > 13)), offsets)


def run_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of marked bytes."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(inside))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each span's content among the distinct ones, and these. The spans do not overlap and are in order."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1  # a span that ends where the next one starts leaves no edge
    packed = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def digest(data: bytes) -> bytes:
    """128 bits of a cryptographic hash."""
    return hashlib.blake2b(data, digest_size=16).digest()


#: Longer words are named by a cryptographic digest.
BLOCKS = 4
_SEEDS = mix(np.array([11, 23], np.uint64) * _STEP)


def _block_names(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two lanes for each span of at most ``BLOCKS`` blocks of eight bytes, mixed in block by block: different for all spans of
    one length up to eight bytes, else by chance alike in 128 bits, whatever regularity the bytes have."""
    tail = np.concatenate([data, np.zeros(8 * BLOCKS + 8, np.uint8)])
    eight = np.ndarray((len(tail) - 7,), "<u8", buffer=tail, strides=(1,))
    names = np.stack([mix(size.astype(np.uint64) * _STEP ^ seed) for seed in _SEEDS])
    for k in range(BLOCKS):
        at = np.flatnonzero(size > 8 * k)
        if not len(at):
            break
        left = np.minimum(size[at] - 8 * k, 8).astype(np.uint64)
        block = eight[starts[at] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        for lane, seed in enumerate(_SEEDS):
            names[lane, at] = mix(mix(names[lane, at] + seed) * np.uint64(3) + block)
    return names


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Names (two lanes, 128 bits) and row of every word of a text column, in order. ``lower`` folds A-Z only."""
    data, offsets = text_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, rows = word_spans(data, offsets)
    size = ends - starts
    names = _block_names(data, starts, size)
    long = np.flatnonzero(size > 8 * BLOCKS)
    if len(long):
        raw = data.tobytes()
        digests = [digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        names[:, long] = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T
    return names, rows


def text_ids(texts: pa.Array) -> list[bytes]:
    """128-bit digests of whole texts."""
    return [digest(t.as_py().encode()) for t in texts]


#: Odd factors of the names in a window, for each lane.
_FACTORS = mix(np.arange(1, 129, dtype=np.uint64) * _STEP).reshape(2, 64) | np.uint64(1)


def window_digests(names: np.ndarray, width: int) -> np.ndarray:
    """A digest, in as many lanes as the names have, for each run of ``width`` consecutive names, by start; the caller drops runs that cross rows."""
    n = max(0, names.shape[1] - width + 1)
    out = np.empty((len(names), n), np.uint64)
    for lane, (values, factors) in enumerate(zip(names, _FACTORS, strict=False)):
        total = np.full(n, width, np.uint64)
        for i in range(width if n else 0):
            total += values[i : i + n] * factors[i]
        out[lane] = mix(total)
    return out


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n rows in a sorted row column."""
    return np.searchsorted(rows, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
