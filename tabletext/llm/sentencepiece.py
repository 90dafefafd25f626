"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces walks each word once; at each end position, the pieces its output links name
relax the best score there (Viterbi). Words are runs between spaces, since no piece of the vocabularies used here goes on
after a space mark; a vocabulary with pieces that do is walked text by text. Equal words of a task are encoded once.

Spaces become the mark U+2581. A mark that stands in the text itself, and characters without a piece, are spelled in byte
pieces, so decoding gives back exactly the text. Ties go to the longer last piece. Edge cases: a null text has null ids
and decodes to null, an empty one has no ids; repeated rows are encoded alike; an empty table gives an empty result; the
added columns replace input columns of the same names.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece as sp
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletext.llm.common import bounded_batches, read, text_chunks

MARK = "\u2581"
#: Score of a character spelled in bytes, far below any sum of piece scores of a word.
BYTE_SCORE = -1e9
#: Encoded words in each of two generations that a task remembers. Only speed depends on it.
REMEMBERED = 120_000
MODEL = os.environ.get("TABLETEXT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


class Pieces:
    """Vocabulary and automaton. ``pieces`` is a list of (piece, score); ``byte_ids`` the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], special: frozenset[int] = frozenset(), prefix: bool = True):
        self.names, self.byte_ids, self.prefix = [p for p, _ in pieces], byte_ids, prefix
        self.special = special
        self.of_byte = {k: b for b, k in enumerate(byte_ids)}
        self.automaton = ahocorasick.Automaton()
        skip = special | set(byte_ids)
        self.crosses = False
        for k, (piece, score) in enumerate(pieces):
            if k in skip or not piece:
                continue
            self.automaton.add_word(piece, (k, len(piece), float(score)))
            self.crosses |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.seen: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        m = sp.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = frozenset(k for k in range(n) if m.is_control(k) or m.is_unknown(k) or m.is_unused(k))
        return cls([(m.id_to_piece(k), m.get_score(k)) for k in range(n)], bytes_, special)

    def viterbi(self, word: str) -> list[int]:
        """Best ids of a word in which spaces are already marks and U+E000 stands for a mark of the text itself."""
        n = len(word)
        best, start, piece = [0.0] + [-float("inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here are final: a character without a better way is spelled in bytes
        for end, (k, size, score) in self.automaton.iter(word):
            while done < end:
                score_here = best[done] + BYTE_SCORE
                done += 1
                if score_here > best[done]:
                    best[done], start[done], piece[done] = score_here, done - 1, -1
            at = end + 1
            score += best[at - size]
            if score > best[at] or score == best[at] and size > at - start[at]:
                best[at], start[at], piece[at] = score, at - size, k
        while done < n:
            score_here = best[done] + BYTE_SCORE
            done += 1
            if score_here > best[done]:
                best[done], start[done], piece[done] = score_here, done - 1, -1
        out, at = [], n
        while at:
            k, at = piece[at], start[at]
            if k >= 0:
                out.append(k)
            else:
                char = MARK if word[at] == "\ue000" else word[at]
                out.extend(self.byte_ids[b] for b in reversed(char.encode()))
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        ids = self.seen.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = np.array(self.viterbi(word), np.int32).tobytes()
            if len(word) <= 64:
                if len(self.seen) >= REMEMBERED:  # words that were met since the last turn stay
                    self.older, self.seen = self.seen, {}
                self.seen[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text of a string column."""
        marked = texts
        if pc.any(pc.match_substring_regex(marked, "[\ue000\u2581]")).as_py():
            return pa.array([None if t is None else self._encode_rare(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
        marked = pc.replace_substring(marked, " ", MARK)
        if self.prefix:
            marked = pc.if_else(pc.equal(marked, ""), marked, pc.binary_join_element_wise(pa.scalar(MARK, marked.type), marked, pa.scalar("", marked.type), null_handling="emit_null"))
        if self.crosses:
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(marked) + 1), pa.int32()), marked.cast(pa.string()))
        else:  # a word is its marks and what follows them
            cut = pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\\2")
            if pc.any(pc.match_substring(marked, "\x00")).as_py():
                return pa.array([None if t is None else self._encode_rare(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
            words = pc.split_pattern(cut, "\x00")
        flat = words.flatten().dictionary_encode()
        ids = [self.word_ids(w) for w in flat.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        joined = np.frombuffer(b"".join(ids), np.int32)
        which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = sizes[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        take = np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], lengths)
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        offsets = ends[bounds].astype(np.int32)
        valid = pc.is_valid(words).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(joined[take]), mask=pa.array(~valid)
        )

    def _encode_rare(self, text: str) -> list[int]:
        """A text that holds marks, private-use stand-ins or zero bytes: spelled where the plain path could not tell them apart."""
        out: list[int] = []
        piece: list[str] = []

        def flush() -> None:
            if piece:
                out.extend(self.viterbi("".join(piece)))
                piece.clear()

        marked = (MARK if self.prefix and text else "") + "".join(MARK if c == " " else "\ue000" if c == MARK else c for c in text)
        private = {i + bool(self.prefix) for i, c in enumerate(text) if c == "\ue000"}
        for i, c in enumerate(marked):
            if i in private:
                flush()
                out.extend(self.byte_ids[b] for b in c.encode())
                continue
            if c == MARK and piece and piece[-1] != MARK and not self.crosses:
                flush()
            piece.append(c)
        flush()
        return out

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids, the inverse of ``encode``."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        table = self._spelled()
        values, offsets = table
        sizes = np.diff(offsets)[flat]
        ends = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        data = values[np.arange(ends[-1]) + np.repeat(offsets[:-1][flat] - ends[:-1], sizes)]
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        at = ends[bounds]
        raw = data.tobytes()
        skip = 1 if self.prefix else 0
        valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        return pa.array(
            [
                None if not ok else raw[a + skip if b > a else a : b].decode("utf-8", "replace")
                for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)
            ],
            pa.string(),
        )

    @functools.cache  # noqa: B019
    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [
            bytes([self.of_byte[k]]) if k in self.of_byte else b"" if k in self.special else n.replace(MARK, " ").encode()
            for k, n in enumerate(self.names)
        ]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        return np.frombuffer(b"".join(parts), np.uint8), offsets


@functools.cache
def pieces_of(name: str) -> Pieces:
    return Pieces.load(SparkFiles.get(name))


def _add_file(spark: SparkSession, model: str) -> str:
    """Send the vocabulary file to all executors, also those that start later; returns its name there."""
    bounded_batches(spark)
    spark.sparkContext.addFile(model)
    return os.path.basename(model)


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c != name]
    return kept, T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, decoded: str | None = None) -> DataFrame:
    """Add the ids of each text, and in the same pass, if ``decoded`` names a column, the text that the ids spell."""
    name = _add_file(docs.sparkSession, model)
    added = [ids] + ([decoded] if decoded else [])
    kept = [c for c in docs.columns if c not in added]
    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, k) for c, k in zip(added, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(name)
        for batch in text_chunks(batches, text, fill=False):
            texts = batch.column(batch.schema.get_field_index(text))
            columns = [texts.cast(pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns.append(pieces.encode(texts))
            if decoded:
                columns.append(pieces.decode(columns[-1]))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text that each list of ids spells."""
    name = _add_file(docs.sparkSession, model)
    kept, schema = _schema_with(docs, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(name)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(batch.schema.get_field_index(ids))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pieces.decode(column)], names=[*kept, text])

    return docs.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.length("decoded").cast("long").alias("n_chars"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
