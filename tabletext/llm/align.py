"""Alignment of two tokenizers over the same texts: groups of tokens that end together, links of tokens that overlap.

Inside ``mapInPandas`` each text is encoded by both tokenizers. The cumulative byte ends of both token sequences are merged as
by two pointers: between two neighbouring ends lies one token of each side, which are a link; where both sides end, a
group ends. Each task numbers the distinct pairs of ids of some megabytes of text (a chunk) and writes, beside one row a
document, one row a chunk with the pairs and the number of documents that hold each. Spark groups these by pair, sums the
documents, takes the maxima of both sides, and joins counts and maxima back to the chunks; the documents of a chunk then read
the counts of their own links. A pair that every document holds is one row a chunk, not one a document.

Tokenizers: a byte-level BPE file in JSON, encoded by its ranks where merges are in order of their ids (else by the library
that the file is made for), and a SentencePiece model. The first is given a space and the text, the second adds its own space.

Edge cases: null and empty texts, and texts whose joined token bytes differ from space and text (as those with U+2581), have
no tokens: zeros and an empty digest. Strings of special tokens in a text are plain text. Repeated rows count as documents
of their own; a null key is kept; an empty table gives an empty result; other columns are not read. A long text is a chunk
of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece as sp
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabletext.llm.common import bounded_batches, read, written

MODEL_A = os.environ.get("TABLETEXT_BYTES", "/opt/tokenizers/byte_bpe_50k.json")
MODEL_B = os.environ.get("TABLETEXT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Bytes of text that share a table of pairs, and those merged at once; a longer text is alone.
CHUNK_BYTES, PART_BYTES = 12 << 20, 1 << 20
#: Fixed value: how byte-level BPE cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOW = (1 << 32) - 1


class Side(NamedTuple):
    """A tokenizer: texts to lists of ids, and the bytes of every id (joined, with offsets)."""

    encode: Callable[[list[str]], list[list[int]]]
    data: np.ndarray
    offsets: np.ndarray

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        sizes = np.diff(self.offsets)[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _side(encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]) -> Side:
    return Side(encode, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64))


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def byte_side(path: str) -> Side:
    """A byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    vocabulary = {t: k for t, k in model["vocab"].items() if all(c in letters for c in t)}
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for t, k in vocabulary.items():
        tokens[k] = bytes(letters[c] for c in t)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocabulary[a + b] for a, b in merges]
    letters_first = all(vocabulary.get(c, 256) < 256 for c in letters)
    if merged == list(range(256, 256 + len(merged))) and letters_first:
        ranks = {tokens[k]: k for k in range(256 + len(merged))}
        coder = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return _side(lambda texts: [coder.encode_ordinary(t) for t in texts], tokens)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return _side(lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)], tokens)


@functools.cache
def piece_side(path: str) -> Side:
    """A SentencePiece model."""
    model = sp.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    tokens = [bytes([int(n[3:5], 16)]) if model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
    return _side(lambda texts: model.encode(texts, num_threads=1), tokens)


class Merged(NamedTuple):
    """Some texts aligned: links as (text, id, id) in order, and per text numbers of tokens and groups, and the groups spelled out."""

    text: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[bytes]


def _spelled_right(side: Side, ids: list[list[int]], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined ids, tokens of each text, and whether they spell it."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    data = side.spelled(flat).tobytes()
    ends = np.concatenate([[0], np.cumsum(np.diff(side.offsets)[flat])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    right = [data[i:j] == w for i, j, w in zip(ends[:-1], ends[1:], wanted, strict=True)]
    return flat, sizes, np.array(right, bool)


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the two tokens of every link, in order, and whether both end there.

    Both sequences of ends are merged; at each end that differs from the last, the tokens of both sides that began before it
    and reach it are linked. What lies before it in the merge are the places of both pointers.
    """
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")  # merges two sorted runs
    ends, is_a = both[order], order < len(ends_a)
    new = np.diff(ends, prepend=-1) > 0
    before_a = np.cumsum(is_a) - is_a
    at = np.flatnonzero(new)
    return before_a[at], at - before_a[at], np.diff(np.append(at, len(ends))) > 1


def _spell_groups(ids: np.ndarray, sep: np.ndarray, text: np.ndarray, n: int) -> list[bytes]:
    """For each text its ids in decimal, each with a mark behind it but the last."""
    width = len(str(int(ids.max(initial=0))))
    digits = np.zeros((len(ids), width + 1), np.uint8)
    rest = ids.astype(np.int64)
    for k in range(width - 1, -1, -1):
        digits[:, k] = np.where((rest > 0) | (k == width - 1), 48 + rest % 10, 0)
        rest = rest // 10
    digits[:, width] = sep
    last = np.flatnonzero(np.diff(text, append=-1))
    digits[last, width] = 0
    used = digits != 0
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, used.sum(axis=1), n))]).astype(np.int64).tolist()
    data = digits[used].tobytes()
    return [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def merge_texts(texts: list[str], a: Side, b: Side) -> Merged:
    """Both tokenizations of some texts, merged."""
    wanted = [f" {t}".encode() for t in texts]
    ids_a, n_a, right_a = _spelled_right(a, a.encode([f" {t}" for t in texts]), wanted)
    ids_b, n_b, right_b = _spelled_right(b, b.encode(texts), wanted)
    right = right_a & right_b & np.array([bool(t) for t in texts], bool)
    of_a, of_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    ids_a, of_a, ids_b, of_b = ids_a[right[of_a]], of_a[right[of_a]], ids_b[right[of_b]], of_b[right[of_b]]
    # the bytes of all texts are one line: both sides end where a text ends
    ends_a, ends_b = np.cumsum(np.diff(a.offsets)[ids_a]), np.cumsum(np.diff(b.offsets)[ids_b])
    at_a, at_b, both = merge_ends(ends_a, ends_b)
    group = np.cumsum(both) - both
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[at_a], group_b[at_b] = group, group
    n = int(both.sum())
    per_a, per_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    place_a = np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]
    size = len(ids_a) + len(ids_b)
    ids, text, sep = np.empty(size, np.int64), np.empty(size, np.int64), np.full(size, ord(","), np.uint8)
    ids[place_a], ids[place_b], text[place_a], text[place_b] = ids_a, ids_b, of_a, of_b
    sep[place_a[np.cumsum(per_a) - 1]], sep[place_b[np.cumsum(per_b) - 1]] = ord("|"), ord(";")
    of_group = of_a[np.cumsum(per_a) - 1]
    return Merged(of_a[at_a], ids_a[at_a], ids_b[at_b], n_a * right, n_b * right, np.bincount(of_group, minlength=len(texts)), _spell_groups(ids, sep, text, len(texts)))


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = 4 * len(t or "")
        if i > start and size + n > PART_BYTES:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


class Chunk:
    """Documents of a task with their links, until a table of pairs is written for them."""

    def __init__(self) -> None:
        self.rows: list[pd.DataFrame] = []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.n = 0

    def add(self, keys: pd.Series, texts: list[str], found: Merged, names: list[str], groups: bool) -> None:
        shown = [g.decode() for g in found.groups] if groups else [None] * len(texts)
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
        links = np.bincount(found.text, minlength=len(texts))
        self.rows.append(pd.DataFrame(dict(zip(names, [keys.to_numpy(), found.n_a, found.n_b, found.n_groups, links, digests, shown], strict=True))))
        self.links.append((found.text + self.n, found.a.astype(np.int64) << 32 | found.b))
        self.n += len(texts)
        self.size += sum(len(t) for t in texts)

    def table(self, chunk: int) -> pd.DataFrame:
        """A row a document, with the places of its distinct pairs and how often it holds each; and one of all pairs."""
        rows = pd.concat(self.rows, ignore_index=True)
        codes, pairs = pd.factorize(np.concatenate([c for _, c in self.links]))
        held, times = np.unique(np.concatenate([t for t, _ in self.links]) * max(1, len(pairs)) + codes, return_counts=True)
        text, place = np.divmod(held, max(1, len(pairs)))
        ends = np.searchsorted(text, np.arange(self.n + 1)).tolist()
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        place, times = place.astype(np.int32), times.astype(np.int32)
        rows["at"], rows["times"] = [place[i:j].tobytes() for i, j in spans], [times[i:j].tobytes() for i, j in spans]
        rows["pairs"], rows["docs"] = None, None
        whole = {c: None for c in rows.columns} | {"pairs": pairs, "docs": np.bincount(place, minlength=len(pairs)).astype(np.int32)}
        if len(pairs):
            rows = pd.concat([rows.astype(object), pd.DataFrame([whole], columns=rows.columns, dtype=object)], ignore_index=True)
        rows["chunk"] = chunk
        return rows


def token_rows(docs: DataFrame, key: str, text: str, model_a: str, model_b: str, groups: bool) -> DataFrame:
    """(chunk, key, n_a, n_b, n_groups, n_links, sha256, groups, at, times, pairs, docs): ``Chunk.table`` of every chunk."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for path in (model_a, model_b):
        spark.sparkContext.addFile(path)
    file_a, file_b = os.path.basename(model_a), os.path.basename(model_b)
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "sha256", "groups"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = byte_side(SparkFiles.get(file_a)), piece_side(SparkFiles.get(file_b))
        chunk, number = Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for i, j in _parts(texts):
                chunk.add(batch["key"].iloc[i:j], texts[i:j], merge_texts(texts[i:j], a, b), names, groups)
                if chunk.size >= CHUNK_BYTES:
                    yield chunk.table(number)
                    chunk, number = Chunk(), number + 1
        if chunk.n:
            yield chunk.table(number)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, sha256 string, groups string, at binary, times binary, pairs array<long>, docs array<int>, chunk long"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)


class Alignment(NamedTuple):
    """``documents``: key, n_a, n_b, n_groups, n_links, sha256, groups, n_best, n_best_b, count_sum; ``pairs``: pair, a, b, docs, best_a, best_b."""

    documents: DataFrame
    pairs: DataFrame


def pair_counts(entries: DataFrame) -> DataFrame:
    """(pair, a, b, docs, best_a, best_b) of (pair, docs) parts: documents that hold a pair linked, and whether no pair of its id has more."""
    counts = entries.groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(_LOW).cast("int").alias("b"), "docs"), "align-counts")
    # no more rows than a vocabulary has ids
    tops = [F.broadcast(counts.groupBy(side).agg(F.max("docs").alias(f"top_{side}"))) for side in ("a", "b")]
    found = counts.join(tops[0], "a").join(tops[1], "b")
    return found.select("pair", "a", "b", "docs", (F.col("docs") == F.col("top_a")).alias("best_a"), (F.col("docs") == F.col("top_b")).alias("best_b"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B, groups: bool = False) -> Alignment:
    """Both tokenizations of every whole text, aligned; with ``groups`` also spelled out (``a1,a2|b1;a3|b2``)."""
    rows = written(token_rows(docs, key, text, model_a, model_b, groups), "align-tokens")
    tables = rows.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p"))
    tables = tables.select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    pairs = written(pair_counts(tables), "align-pairs")
    back = tables.drop("docs").join(pairs, "pair").select(F.col("chunk").alias("chunk_of"), "place", "docs", "best_a", "best_b")
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "sha256", "groups"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, sha256 string, groups string, n_best long, n_best_b long, count_sum long"

    def run(own: pa.Table, counted: pa.Table) -> pa.Table:
        counted = counted.sort_by("place")
        count = counted.column("docs").to_numpy()
        best = [counted.column(c).to_numpy().astype(np.int64) for c in ("best_a", "best_b")]
        sums: list[list[int]] = [[], [], []]
        for at, times in zip(own.column("at").to_pylist(), own.column("times").to_pylist(), strict=True):
            place, n = np.frombuffer(at, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
            for out, value in zip(sums, (*best, count), strict=True):
                out.append(int((value[place] * n).sum()))
        names = ["n_best", "n_best_b", "count_sum"]
        return pa.table({c: own.column(c) for c in kept} | {n: pa.array(s, pa.int64()) for n, s in zip(names, sums, strict=True)})

    texts = rows.where("pairs is null").select("chunk", *kept, "at", "times")
    return Alignment(texts.groupBy("chunk").cogroup(back.groupBy("chunk_of")).applyInArrow(run, schema), pairs)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary over every document."""
    found = align(read(spark, sf_dir, "documents")).documents
    return found.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha256").alias("groups_sha256"), "n_best_b")
