"""Interleaved document sequences: HTML to ordered text and media references, resolved by digest.

Parsing gives each page an array of items in document order: text blocks, and references to images, audio and video with
their captions. References name their payload by digest; a join by digest resolves them, and the items keep positions and
captions. Payloads are kept in a media store, a table (digest, media) of PNG images with 8-bit samples, written once and
read back to be looked at.

Edge cases: null or empty HTML has no items; a reference without a digest, or to a payload that is not stored, stays in
its place with null payload columns; repeated references are all resolved; equal payloads are stored once by each task and
resolved once; an empty table gives an empty result; other columns are kept beside the items.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletext.llm.common import read, text_chunks, written

#: Samples in a row of an image; payloads are padded to a multiple of it.
ROW = 192
_MEDIA = {"img": "image", "video": "video", "audio": "audio"}
#: Elements whose text is not shown. The end tag of head is optional; what it holds beside these is shown nowhere or is body already.
_HIDDEN = {"script", "style", "template", "noscript", "title"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
ITEM = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType()),
])
_ITEM_ARROW = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "ref", "digest", "caption")]]))


class Sequence(HTMLParser):
    """Collects the items of one page. A caption ends with its tag, its figure, the next caption or figure, or the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None  # items of the open figure
        self.hidden = dict.fromkeys(_HIDDEN, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        for i in self.figure or []:
            self.items[i]["caption"] = text or self.items[i].get("caption")
        if not self.figure and text:  # a caption of no media stays as text
            self.items.append({"kind": "text", "text": text})

    def end(self) -> None:
        self.end_caption()
        self.flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden[tag] += 1
        if tag == "body":
            self.hidden["title"] = self.hidden["noscript"] = 0
        if tag in ("figure", "figcaption"):
            self.end_caption()
        if self.caption is None and (tag in _BLOCKS or tag in _MEDIA):
            self.flush()
        if tag in _BLOCKS and self.caption is not None:
            self.caption.append(" ")
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA or tag == "source":
            found = dict(attrs)
            if tag == "source" and self.items and self.items[-1].get("ref") is None and self.items[-1]["kind"] in ("video", "audio"):
                item = self.items[-1]
            elif tag == "source":
                return
            else:
                item = {"kind": _MEDIA[tag], "caption": (found.get("alt") or "").strip() or None}
                self.items.append(item)
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
            item["ref"] = found.get("src")
            digest = found.get("data-digest") or found.get("src") or ""
            item["digest"] = digest.removeprefix("sha256:").lower() if digest.startswith("sha256:") else None

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN and self.hidden[tag]:
            self.hidden[tag] -= 1
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag in _BLOCKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not any(self.hidden.values()):
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str) -> list[dict]:
    parser = Sequence()
    parser.feed(html)
    parser.close()
    parser.end()
    return [dict.fromkeys(ITEM.names) | item | {"position": i} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, html: str = "html", items: str = "items") -> DataFrame:
    """Replace the HTML by its items."""
    kept = [c for c in pages.columns if c not in (html, items)]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(items, T.ArrayType(ITEM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, html):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            found = [sequence(t) for t in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ITEM_ARROW)], names=[*kept, items])

    return pages.select(*kept, html).mapInArrow(run, schema)


def resolve(sequences: DataFrame, facts: DataFrame, key: str, items: str = "items") -> DataFrame:
    """One row for each item, in its place, with the columns of ``facts`` (one row a digest) beside media references."""
    flat = sequences.select(key, F.explode_outer(items).alias("item")).select(key, "item.*")
    return flat.join(facts.withColumnRenamed("digest", "media_digest"), F.col("digest") == F.col("media_digest"), "left").drop("media_digest")


# --- PNG images with one 8-bit sample a pixel


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image, ROW samples wide, whose samples are the payload's bytes."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image that ``to_png`` made; ValueError if it is damaged."""
    at, data, size = 8, [], None
    while at < len(media):
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0]:
            raise ValueError("chunk does not match its checksum")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    width, height = size or (0, 0)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read here")
    return lines[:, 1:]


def padded(text: str) -> bytes:
    data = text.encode()
    return data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """A media store with an image of each text: (digest of the payload, media), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # digests of this task
        for batch in text_chunks(batches, text):
            rows = []
            for t in batch.column(0):
                payload = padded(t.as_py())
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    rows.append((digest.hexdigest(), to_png(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.binary()))], names=["digest", "media"])

    return written(docs.select(text).mapInArrow(run, "digest string, media binary"), "media-store")


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_facts(store: DataFrame) -> DataFrame:
    """Read every stored image and describe payload and image; one row a digest."""
    names = [c.split()[0] for c in FACTS.split(", ")]

    def describe(digest: str, media: bytes) -> tuple:
        samples = from_png(media)
        payload = samples.tobytes()
        counts = np.bincount(samples.ravel() >> 5, minlength=8)
        feature = f"{samples.shape[1]}x{samples.shape[0]} mean={samples.sum(dtype=np.int64) / samples.size:.4f} eighths={'/'.join(map(str, counts))}"
        return digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(d.as_py(), m.as_py()) for d, m in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i in (0, 2, 5, 6) else pa.int64()) for i in range(7)], names=names)

    return store.select("digest", "media").mapInArrow(run, FACTS).groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def pages_of_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, html): the lines of the text as paragraphs, and between them a reference to its image, with a caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                digest = hashlib.sha256(padded(t)).hexdigest()
                size = len(t.encode())
                lines = [f"<p>{escape(line, quote=False)}" for line in t.split("\n")]
                middle = f'<figure><img src="sha256:{digest}"><figcaption>{size} bytes</figure>'
                rows.append((size, f"<html><head><title>Text</title><body>{''.join(lines[: len(lines) // 2])}{middle}{''.join(lines[len(lines) // 2 :])}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["key", "n_bytes", "html"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_bytes long, html string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a page of its lines with one image between them; the image comes from the store by digest."""
    docs = read(spark, sf_dir, "documents")
    # written, so that a digest that very many texts share can be split in the join
    facts = written(media_facts(store_texts(docs)), "media-facts")
    items = resolve(interleave(pages_of_texts(docs)), facts, "key").where("kind = 'image'")
    return items.select(
        F.col("key").alias("doc_id"),
        F.regexp_extract("caption", "^([0-9]+) bytes$", 1).cast("long").alias("n_bytes"),
        "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption",
    )
