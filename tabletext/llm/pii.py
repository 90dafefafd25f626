"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans they miss.

The base patterns find e-mail, IP, card and phone spans. The field scores whole candidate segments (digit counts,
checksum, grouping, shape, words before) and a dynamic program over segments of at most ``MAX_TOKENS`` tokens chooses
boundaries and kinds together; it adds no longer ones. It is fitted on islands of tokens of a bounded sample of distinct
texts, labelled by the base patterns; half of the training copies hide the surface marks that the base patterns need, so
that the field learns the rest. Base spans always stay; the field works on what lies between them.

Edge cases: a null text counts as empty and has no spans; equal texts have equal spans; an empty table gives an empty
result (and an untrained field, which adds nothing); the added columns replace input columns of the same names.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletext.llm.common import bounded_batches, drop_written, mix, read, text_chunks, written

KINDS = ["email", "ip", "card", "phone"]
#: Longest entity in tokens, the bound of the dynamic program.
MAX_TOKENS = 6
#: Distinct texts with a digit or @ that the field is fitted on, about (those with the smallest hashes); and islands taken
#: from them, at most half of them with base spans.
SAMPLE_DOCS = 1500
SAMPLE_ISLANDS = 400
#: A longer island is cut for training, between entities.
ISLAND_TOKENS = 24
SEED = "pii"

Span = tuple[int, int, int]  # start, end, kind

# The first character of each run is required, so that a failed run is not tried again from its middle.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), 0
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind."""
    out = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p[-4:] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() >= 14 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the field: tokens, features, dynamic program

_TOKEN = re.compile(r"\S*(?:[0-9@]|[\[(]at[\])])\S*")
_EDGE = ".,;:!?\"'<>[]{}|"
_WORDS = [
    {"tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"},
    {"mail", "email", "e-mail", "contact", "write"},
    {"card", "visa", "karte", "carte", "tarjeta", "account"},
    {"ip", "host", "server", "address", "from"},
]
_EMAIL_SHAPE = re.compile(r"[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
_GROUPED = re.compile(r"[0-9]{2,6}([ -][0-9]{2,6})+")
_FOURS = re.compile(r"[0-9]{4}([ -]?[0-9]{4}){2,3}[0-9 -]{0,4}")
N_FEATURES = 28
#: Features that stand for the marks of the base patterns; hidden in half of the training copies.
SURFACE = [10, 13]


def features(text: str, start: int, end: int, tokens: int, before: list[str]) -> list[int]:
    """Indices of the features of a whole segment."""
    s = text[start:end]
    digits = _digits(s)
    n = len(digits)
    out = [0, 4 if n < 7 else 5 if n < 10 else 6 if n < 13 else 7 if n < 16 else 8 if n < 20 else 9]
    out += [k for k, hit in (
        (1, "@" in s),
        (2, "@" in s and _EMAIL_SHAPE.fullmatch(s)),
        (3, "at]" in s or "at)" in s),
        (10, 13 <= n <= 19 and luhn(digits)),
        (11, _QUAD.fullmatch(s)),
        (12, _QUAD.fullmatch(s) and all(int(p) < 256 for p in s.split("."))),
        (13, s[0] == "+"),
        (14, "(" in s),
        (15, any(c.isalpha() for c in s)),
        (16, n == len(s)),
        (17, _GROUPED.fullmatch(s)),
        (18, "." in s),
        (19, tokens == 1),
        (20, tokens == 2),
        (21, tokens > 2),
        *((22 + i, any(w in words for w in before)) for i, words in enumerate(_WORDS)),
        (26, "/" in s or ":" in s),
        (27, _FOURS.fullmatch(s)),
    ) if hit]
    return out


def islands(text: str, taken: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that could hold personal data, without those that base spans cover."""
    run: list[tuple[int, int]] = []
    ends = sorted(s[:2] for s in taken)
    starts = [s[0] for s in ends]
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if start == end:
            continue
        i = bisect.bisect_left(starts, end)
        covered = any(e > start for _, e in ends[max(0, i - 8) : i])
        if run and (covered or start - run[-1][1] > 3):
            yield run
            run = []
        if not covered:
            run.append((start, end))
    if run:
        yield run


def segments(text: str, run: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Features of every segment [i, j) of at most MAX_TOKENS tokens."""
    out = {}
    for i, (start, _) in enumerate(run):
        before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - 40) : start].lower())[-3:]
        for j in range(i + 1, min(len(run), i + MAX_TOKENS) + 1):
            out[i, j] = features(text, start, run[j - 1][1], j - i, before)
    return out


class Field:
    """Weights by kind (0: outside, one token at a time) and feature, and of steps from kind to kind."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        k = len(KINDS) + 1
        self.weights = np.zeros((k, N_FEATURES)) if weights is None else weights
        self.steps = np.zeros((k, k)) if steps is None else steps
        self.trained = weights is not None

    def scores(self, segs: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for (i, j), f in segs.items():
            s = self.weights[:, f].sum(axis=1)
            if j - i > 1:
                s[0] = -np.inf
            out[i, j] = s
        return out

    def best(self, n: int, segs: dict[tuple[int, int], list[int]]) -> list[tuple[int, int, int]]:
        """Highest-scoring cut into segments: (first token, end token, kind)."""
        scores, k = self.scores(segs), len(KINDS) + 1
        value, back = np.full((n + 1, k), -np.inf), {}
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_TOKENS), j):
                into = np.zeros(k) if i == 0 else (value[i][:, None] + self.steps).max(axis=0)
                prev = [0] * k if i == 0 else (value[i][:, None] + self.steps).argmax(axis=0)
                total = into + scores[i, j]
                for y in np.flatnonzero(total > value[j]):
                    value[j, y], back[j, int(y)] = total[y], (i, int(prev[y]))
        out, j, y = [], n, int(value[n].argmax())
        while j > 0:
            i, p = back[j, y]
            out.append((i, j, y))
            j, y = i, p
        return out[::-1]

    def gradient(self, n: int, segs: dict[tuple[int, int], list[int]], gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected feature counts of one island (forward-backward over segments)."""
        scores, k = self.scores(segs), len(KINDS) + 1
        reach = lambda a: np.logaddexp.reduce(a[:, None] + self.steps, axis=0)
        alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        beta[n] = 0
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([(np.zeros(k) if i == 0 else reach(alpha[i])) + scores[i, j] for i in range(max(0, j - MAX_TOKENS), j)], axis=0)
        for i in range(n - 1, 0, -1):
            onward = np.logaddexp.reduce([scores[i, j] + beta[j] for j in range(i + 1, min(n, i + MAX_TOKENS) + 1)], axis=0)
            beta[i] = np.logaddexp.reduce(self.steps + onward, axis=1)
        z = np.logaddexp.reduce(alpha[n])
        dw, ds = np.zeros_like(self.weights), np.zeros_like(self.steps)
        for (i, j), f in segs.items():
            p = np.exp((np.zeros(k) if i == 0 else reach(alpha[i])) + scores[i, j] + beta[j] - z)
            dw[:, f] -= p[:, None]
            if i:
                ds -= np.exp(alpha[i][:, None] + self.steps + (scores[i, j] + beta[j])[None, :] - z)
        last = None
        for i, j, y in gold:
            dw[y, segs[i, j]] += 1
            if last is not None:
                ds[last, y] += 1
            last = y
        return dw, ds


def training_islands(text: str) -> Iterator[tuple[bool, tuple[int, dict, list]]]:
    """(whether it holds base spans, island) with base labels; where a base span is not a whole run of tokens, the island is left out."""
    spans = base_spans(text)
    for whole in islands(text, []):
        for run in _cut(whole, spans):
            inside = [s for s in spans if s[0] < run[-1][1] and s[1] > run[0][0]]
            starts, ends = {a: i for i, (a, _) in enumerate(run)}, {b: i + 1 for i, (_, b) in enumerate(run)}
            gold, at = [], 0
            for a, b, kind in inside:
                i, j = starts.get(a), ends.get(b)
                if i is None or j is None or i < at or j - i > MAX_TOKENS:
                    break
                gold += [(t, t + 1, 0) for t in range(at, i)] + [(i, j, kind + 1)]
                at = j
            else:
                gold += [(t, t + 1, 0) for t in range(at, len(run))]
                yield bool(inside), (len(run), segments(text, run), gold)


def _cut(run: list[tuple[int, int]], spans: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """Pieces of about ISLAND_TOKENS tokens that cut no span."""
    start = 0
    for i in range(1, len(run)):
        if i - start >= ISLAND_TOKENS and not any(a < run[i][0] and b > run[i - 1][1] for a, b, _ in spans):
            yield run[start:i]
            start = i
    if start < len(run):
        yield run[start:]


def fit_field(docs: DataFrame, text: str = "text", passes: int = 40, rate: float = 0.3) -> Field:
    """Fit on islands of some SAMPLE_DOCS texts with candidates, a share by hash of all such texts, of any length."""
    key = F.xxhash64(F.lit(SEED), F.col(text))
    candidates = docs.where(F.col(text).rlike("[0-9@]"))
    share = min(1.0, SAMPLE_DOCS / max(1, candidates.select(F.approx_count_distinct(key, 0.02)).first()[0]))
    few = F.pmod(F.xxhash64(F.lit(f"{SEED}:share"), F.col(text)), F.lit(10**12)) < F.lit(int(share * 10**12))
    sample = candidates.where(few).select(F.col(text).alias("t"), key.alias("k")).dropDuplicates(["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = [(inside, pickle.dumps(island)) for inside, island in training_islands(t.as_py())]
                order = [mix(np.array([k + i & 2**64 - 1], np.uint64))[0] >> np.uint64(1) for i in range(len(found))]
                columns = [pa.array(np.array(order, np.int64)), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["turn", "inside", "island"])

    found = written(sample.mapInArrow(run, "turn long, inside boolean, island binary"), "pii-islands")
    half = SAMPLE_ISLANDS // 2
    rows = [r for inside in (True, False) for r in found.where(F.col("inside") == inside).orderBy("turn", "island").limit(half).collect()]
    drop_written(found)
    data = [pickle.loads(r["island"]) for r in rows]
    if not data:
        return Field()
    field = Field(np.zeros((len(KINDS) + 1, N_FEATURES)))
    hidden = [(n, {s: [f for f in fs if f not in SURFACE] for s, fs in segs.items()}, gold) for n, segs, gold in data]
    gw, gs = np.full_like(field.weights, 1e-6), np.full_like(field.steps, 1e-6)
    for turn in range(passes):
        dw, ds = -0.02 * field.weights, -0.02 * field.steps
        for island in data if turn % 2 else hidden:
            a, b = field.gradient(*island)
            dw, ds = dw + a, ds + b
        gw, gs = gw + dw**2, gs + ds**2
        field.weights, field.steps = field.weights + rate * dw / np.sqrt(gw), field.steps + rate * ds / np.sqrt(gs)
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those that the field adds."""
    base = base_spans(text)
    added = []
    if field.trained:
        for run in islands(text, base):
            added += [
                (run[i][0], run[j - 1][1], y - 1) for i, j, y in field.best(len(run), segments(text, run)) if y
            ]
    return base, sorted({*base, *added}, key=lambda s: (s[0], s[2], s[1]))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, field: Field | None = None, text: str = "text", redact: bool = False) -> DataFrame:
    """Add ``base_spans`` and ``pii_spans``, arrays of (kind, start, end) in code points; with ``redact`` also ``redacted``."""
    bounded_batches(docs.sparkSession)
    field = field or fit_field(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some hundred numbers
    names = ["base_spans", "pii_spans"] + ["redacted"] * redact
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, T.StringType() if n == "redacted" else SPAN_TYPE) for n in names]])
    listed = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in text_chunks(batches, text, fill=False):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            both = [all_spans(t, field) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns = [c.cast(pa.string()) if c.type == pa.large_string() else c for c in columns]
            columns += [pa.array([listed(s[i]) for s in both], _SPAN_ARROW) for i in (0, 1)]
            if redact:
                columns.append(pa.array([redacted(t, s[1]) for t, s in zip(texts, both, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and all spans of every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("pii_spans").alias("spans")
    )
