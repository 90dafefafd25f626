"""Toxicity by weak supervision.

Lexicon and pattern voters look at each text. A generative label model, fitted by expectation maximization on how often
each combination of votes occurs over all documents, estimates how accurate the voters are in each class and, by a tree of
the strongest dependencies given the class, how they correlate; labelled documents count there with their label. Its
posterior labels, of a hashed sample of all documents and of the labelled ones, train a linear classifier on counts and
densities of what the voters saw; the classifier gives the score. ``Toxicity.learned`` states accuracies and dependencies.

Words are runs of Unicode letters, for voters and for learning alike. The lexicon holds insults and stems that are learned
from labelled documents: prefixes that occur in toxic documents and next to never in others. Only rows whose ``learn`` flag
holds teach anything; at most ``SAMPLE_ROWS`` labelled documents and as many of all documents (those with the smallest
hashes) are read for learning. Vote counts cover all documents.

Edge cases: a null or empty text has no hits and gets the low score of a text without words; equal texts have equal
scores; without usable labels only the fixed lexicon votes; an empty table gives an empty result; other columns are not
read. A document with several labels counts as toxic if any says so.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.llm.common import drop_written, read, run_spans, span_codes, text_bytes, text_chunks, written

#: Labelled documents that stems and classifier are learned from, at most; and documents of any kind for the classifier.
SAMPLE_ROWS = 20_000
STEM_BYTES = range(4, 9)
#: Insults known beforehand.
SEEDS = ["idiot", "moron", "stupid", "loser", "clown", "trash", "scum", "pathetic", "worthless", "disgusting"]
#: Words of address, in English, German, French and Spanish.
ADDRESS = ["you", "your", "youre", "du", "dein", "ihr", "tu", "toi", "vous", "eres", "usted", "tú"]
VOTERS = [
    "seed", "two seeds", "stem", "two stem forms", "two loose forms", "three loose forms", "dense", "spelled in digits", "addressed",
    "shouted", "loose form", "clean", "long and clean",
]
#: A voter that says only that others say nothing: a leaf of the tree that adds no factor to the likelihood.
DERIVED = VOTERS.index("clean")
#: A stem is firm if nearly all labelled documents with it are toxic, else loose.
COUNTS = ["words", "seed", "seeds", "firm", "firm forms", "loose", "loose forms", "leet", "addressed", "shouted"]

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _LEET[_a] = _b
_SIGN = np.zeros(256, bool)
_SIGN[list(b"013457@$")] = True


@functools.cache
def _alphabet() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of UTF-8 text that belong to letters."""
    plain = (data >= 97) & (data <= 122) | (data >= 65) & (data <= 90)
    heads = np.flatnonzero(data >= 0xC0)
    if not len(heads):
        return plain
    size = 2 + (data[heads] >= 0xE0) + (data[heads] >= 0xF0)
    point = (data[heads] & np.array([0x1F, 0x0F, 0x07], np.uint8)[size - 2]).astype(np.int64)
    tail = np.concatenate([data, np.zeros(3, np.uint8)])
    for k in (1, 2, 3):
        point = np.where(size > k, point << 6 | tail[heads + k] & 0x3F, point)
    heads, size = (x[_alphabet()[np.minimum(point, 0x10FFFF)]] for x in (heads, size))
    for k in range(4):
        plain[heads[size > k] + k] = True
    return plain


def prefixes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each start, as whole numbers of at most eight bytes, by columns."""
    tail = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.zeros((-(-size // 8), len(starts)), np.uint64)
    for k in range(size):
        out[k // 8] = out[k // 8] << np.uint64(8) | tail[starts + k]
    return out


class Lexicon:
    """Stems by byte length; a word hits the shortest stem that it starts with. Seeds come first, then firm and loose stems."""

    def __init__(self, firm: list[str], loose: list[str]):
        self.stems = [*SEEDS, *[s for s in firm if s not in SEEDS], *[s for s in loose if s not in SEEDS]]
        self.bounds = [0, len(SEEDS), len(self.stems) - len([s for s in loose if s not in SEEDS]), len(self.stems)]
        coded = [s.encode() for s in self.stems]
        self.by_size = {}
        for size in sorted({len(c) for c in coded}):
            which = np.array([i for i, c in enumerate(coded) if len(c) == size])
            keys = prefixes(np.frombuffer(b"".join(coded[i] for i in which), np.uint8), np.arange(len(which)) * size, size)
            order = np.lexsort(keys[::-1])
            self.by_size[size] = keys[:, order], which[order]

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of the stem of each word, -1 if it has none."""
        out = np.full(len(starts), -1)
        for size, (keys, which) in self.by_size.items():
            long = np.flatnonzero((ends - starts >= size) & (out < 0))
            key = prefixes(data, starts[long], size)
            at = np.searchsorted(keys[0], key[0])
            for _ in range(np.unique(keys[0], return_counts=True)[1].max()):  # stems that share their first eight bytes
                near = np.minimum(at, len(which) - 1)
                ok = (keys[:, near] == key).all(axis=0)
                out[long[ok]] = which[near[ok]]
                at = at + 1
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """COUNTS of each text."""
        n = len(texts)
        data, offsets = text_bytes(pc.utf8_lower(texts))
        raw, raw_offsets = text_bytes(texts)
        letter = letters(data)
        starts, ends, rows = run_spans(letter, offsets)
        hit = self.hits(data, starts, ends)
        tiers = []
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):  # tokens and distinct words of each tier
            at = np.flatnonzero((hit >= a) & (hit < b))
            pairs = np.unique(np.column_stack([rows[at], span_codes(data, starts[at], ends[at])[0]]), axis=0)
            tiers += [np.bincount(rows[at], minlength=n), np.bincount(pairs[:, 0].astype(np.int64), minlength=n)]
        # a word of address right before the hit
        found = np.flatnonzero(hit >= 0)
        before = found[(found > 0) & (rows[np.maximum(found - 1, 0)] == rows[found])] - 1
        codes, words = span_codes(data, starts[before], ends[before])
        known = np.array([w.decode("utf-8", "replace") in ADDRESS for w in words.to_pylist()], bool)
        addressed = np.bincount(rows[before[known[codes]]] if len(codes) else rows[:0], minlength=n)
        # hits in capitals; only where lower-casing keeps byte positions
        same = np.diff(offsets) == np.diff(raw_offsets)
        loud = found[same[rows[found]]]
        shift = raw_offsets[:-1][rows[loud]] - offsets[:-1][rows[loud]]
        capital = (raw[starts[loud] + shift] >= 65) & (raw[starts[loud] + shift] <= 90) & (raw[starts[loud] + shift + 1] >= 65) & (raw[starts[loud] + shift + 1] <= 90)
        shouted = np.bincount(rows[loud[capital]], minlength=n)
        # digits and signs for letters, in words that hold both
        signs = (_LEET[data] != data)
        leet = np.zeros(n, np.int64)
        if signs.any():
            s2, e2, r2 = run_spans(letter | _SIGN[data], offsets)
            total = np.concatenate([[0], np.cumsum(signs)])
            odd = total[e2] - total[s2]
            mixed = (odd > 0) & (odd * 2 <= e2 - s2)
            s2, e2, r2 = s2[mixed], e2[mixed], r2[mixed]
            if len(s2):
                plain = self.hits(_LEET[data], s2, e2) >= 0
                leet = np.bincount(r2[plain], minlength=n)
        words = np.bincount(rows, minlength=n)
        return np.column_stack([words, *tiers, leet, addressed, shouted]).astype(np.float64)


def votes_of(counts: np.ndarray) -> np.ndarray:
    """Votes as bits of an integer, one for each of VOTERS."""
    words, seed, seeds, firm, forms, loose, loose_forms, leet, addressed, shouted = counts.T
    hits = seed + firm + loose
    none = hits + leet == 0
    said = [
        seed > 0, seeds > 1, firm > 0, forms > 1, loose_forms > 1, loose_forms > 2, (hits > 1) & (hits * 100 > words), leet > 0, addressed > 0,
        shouted > 0, loose > 0, none, none & (words >= 100),
    ]
    return sum((v.astype(np.int64) << i for i, v in enumerate(said)), np.zeros(len(words), np.int64))


def inputs_of(counts: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: a constant, logs of counts, densities, and whether there is any hit."""
    words, hits = counts[:, 0], counts[:, 1] + counts[:, 3] + counts[:, 5]
    sure = counts[:, 1] + counts[:, 3] > 0
    return np.column_stack([
        np.ones(len(counts)), np.log1p(counts) / 5, np.minimum(20 * hits / np.maximum(words, 1), 1), sure, counts[:, 7] > 0,
        counts[:, 6] > 1, counts[:, 6] > 2, counts[:, 6] > 4,
    ])


class LabelModel:
    """Class-conditional tree over voters: p(class), and p(vote | vote of its parent, class)."""

    def __init__(self, votes: np.ndarray, weight: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 30):
        """Rows are vote combinations: how often they occur, and how often among labelled toxic and clean documents."""
        m = len(VOTERS)
        self.bits = (votes[:, None] >> np.arange(m)) & 1
        free = np.maximum(weight - toxic - clean, 0)
        says = self.bits[:, :10].any(axis=1)
        post = np.where(says, 0.8, 0.02)
        self.parents = [-1] * m
        for turn in range(rounds):
            if turn == rounds // 2:
                self.parents = self._tree(free * post + toxic, free * (1 - post) + clean)
            like = self._fit(free * post + toxic, free * (1 - post) + clean)
            post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        self.votes, self.posterior = votes, post

    def _fit(self, one: np.ndarray, zero: np.ndarray) -> list[np.ndarray]:
        """Log joint of each combination with class 0 and class 1."""
        out, self.accuracy = [], []
        total = one.sum() + zero.sum() + 2
        for w in (zero, one):
            like = np.full(len(w), np.log((w.sum() + 1) / total))
            rates = []
            for i, p in enumerate(self.parents):
                v = self.bits[:, i]
                for state in (0, 1) if p >= 0 else (None,):
                    at = slice(None) if state is None else self.bits[:, p] == state
                    rate = ((w * v)[at].sum() + 0.5) / (w[at].sum() + 1)
                    if i != DERIVED:
                        like[at] += np.where(v[at] == 1, np.log(rate), np.log(1 - rate))
                rates.append(((w * v).sum() + 0.5) / (w.sum() + 1))
            out.append(like)
            self.accuracy.append(rates)
        return out

    def _tree(self, one: np.ndarray, zero: np.ndarray) -> list[int]:
        """Maximum spanning tree of the voters' mutual information given the class."""
        m = self.bits.shape[1]
        info = np.zeros((m, m))
        for w in (one, zero):
            w = w / (one.sum() + zero.sum())
            size = w.sum() + 1e-12
            for i in range(m):
                for j in range(i):
                    for a in (0, 1):
                        for b in (0, 1):
                            p = w[(self.bits[:, i] == a) & (self.bits[:, j] == b)].sum()
                            pa_, pb = w[self.bits[:, i] == a].sum(), w[self.bits[:, j] == b].sum()
                            if p > 0:
                                info[i, j] += p * np.log(p * size / (pa_ * pb))
                    info[j, i] = info[i, j]
        parents, inside = [-1] * m, [0]
        while len(inside) < m:
            left = [j for j in range(m) if j not in inside and j != DERIVED] or [DERIVED]
            _, new, parent = max((info[i, j], -j, i) for i in inside if i != DERIVED for j in left)
            parents[-new] = parent
            inside.append(-new)
        return parents


def fit_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-4)[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) / len(x) - ridge * w)
    return w


def _stems(texts: pa.Array) -> list[set[str]]:
    """Prefixes of the words of each text."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    starts, ends, rows = run_spans(letters(data), offsets)
    codes, words = span_codes(data, starts, ends)
    cut = [[w[:size].decode() for size in STEM_BYTES if len(w) >= size and (len(w) == size or w[size] & 0xC0 != 0x80)] for w in words.to_pylist()]
    out: list[set[str]] = [set() for _ in range(len(texts))]
    for row, code in {*zip(rows.tolist(), codes.tolist(), strict=True)}:
        out[row].update(cut[code])
    return out


def smallest_hashes(rows: DataFrame, key: str, size: int, *then: str) -> DataFrame:
    """The rows with the smallest hashes of a key, about as many as ``size`` and no more; ties are settled by other columns."""
    share = min(1.0, 1.5 * size / max(1, rows.count()))  # so that tasks send few rows each
    few = F.pmod(F.xxhash64(F.lit("share"), key), F.lit(10**12)) < F.lit(int(share * 10**12))
    return rows.where(few).orderBy(F.xxhash64(key), key, *then).limit(size)


def learn_stems(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Prefixes that mark toxic documents, firm and loose ones, from (text, toxic) rows of a bounded sample."""

    def tally(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for stems, toxic in zip(_stems(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    found.update((s, toxic) for s in (stems if wanted is None else stems & wanted))
                if len(found) > 500_000:
                    yield out(found)
                    found.clear()
            yield out(found)

        def out(found: Counter) -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], names=["stem", "toxic", "n"]
            )

        return run

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic"))
    kind = "stem string, toxic int, n long"
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return [], []
    base = total[1] / (total[0] + total[1])
    least = max(4, total[1] / 500)
    tried = rows.where("toxic = 1").mapInArrow(tally(None), kind).groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    tried = {r["stem"]: r["n"] for r in tried.collect()}  # of the sample
    clean = rows.where("toxic = 0").mapInArrow(tally(frozenset(tried)), kind).groupBy("stem").agg(F.sum("n").alias("n")).collect()
    clean = {r["stem"]: r["n"] for r in clean}

    def marks(n: int, c: int) -> bool:
        """Whether n toxic and c other documents with a stem are far from chance (Chernoff's bound, over all stems tried)."""
        share = n / (n + c)
        if share < max(0.3, 2 * base):
            return False
        far = share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if share < 1 else 0)
        return (n + c) * far > np.log(max(len(tried), 1000) / 1e-3)

    good = {s for s, n in tried.items() if marks(n, clean.get(s, 0))}

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(s & good) for s in _stems(batch.column(0))], pa.list_(pa.string()))], names=["stems"])

    left = [r["stems"] for r in rows.where("toxic = 1").mapInArrow(mine, "stems array<string>").collect()]  # of the sample
    kept: list[str] = []
    while left:  # stems that only occur beside kept ones, as words of copied documents do, add nothing
        cover = Counter(s for stems in left for s in stems)
        if not cover:
            break
        most = max(cover.values())
        stem = max((s for s, n in cover.items() if n >= 0.98 * most), key=lambda s: (-clean.get(s, 0), len(s), s))
        if cover[stem] < least or not marks(tried[stem], clean.get(stem, 0)):
            break
        kept.append(stem)
        left = [stems for stems in left if stem not in stems]
    firm = [s for s in kept if clean.get(s, 0) * 9 <= tried[s]]
    return firm, [s for s in kept if s not in firm]


class Toxicity:
    """A fitted lexicon, classifier and label model.

    ``learned``: for each voter, how often it fires among clean and toxic documents, and the voter it depends on.
    """

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, posteriors: np.ndarray, learned: dict[str, tuple]):
        self.lexicon, self.weights, self.posteriors, self.learned = lexicon, weights, posteriors, learned

    def scores(self, counts: np.ndarray) -> np.ndarray:
        # summed row by row and rounded: equal texts get equal scores in any batch
        return np.round(1 / (1 + np.exp(-np.clip((inputs_of(counts) * self.weights).sum(axis=1), -30, 30))), 12)


def _counts(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(COUNTS)).astype(float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Toxicity, DataFrame]:
    """The fitted model, and (key, votes, counts) of every document. ``learn`` says which labels may be used."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = labels.where(learn & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("toxic"))
    known = written(smallest_hashes(known.where("key is not null"), "key", SAMPLE_ROWS), "toxicity-labels")
    # at most SAMPLE_ROWS keys and labels
    lexicon = Lexicon(*learn_stems(docs.join(F.broadcast(known), "key")))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            counts = shared.value.counts(batch.column(1))
            flat = pa.array(counts.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * len(COUNTS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes_of(counts)), lists], names=["key", "votes", "counts"])

    seen = docs.mapInArrow(look, f"key {docs.schema['key'].dataType.simpleString()}, votes long, counts array<float>")
    seen = written(seen, "toxicity-votes")
    voted = seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** len(VOTERS) rows
    labelled = seen.join(F.broadcast(known), "key")
    tally = {(r["votes"], r["toxic"]): r["n"] for r in labelled.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    votes = np.array([r["votes"] for r in voted], np.int64)
    of = lambda t: np.array([tally.get((v, t), 0) for v in votes.tolist()], float)
    weights, learned = np.zeros(len(inputs_of(np.zeros((1, len(COUNTS))))[0])), {}
    posteriors = np.zeros(1 << len(VOTERS))
    if len(votes):
        model = LabelModel(votes, np.array([r["n"] for r in voted], float), of(1), of(0))
        posteriors[votes] = model.posterior
        learned = {
            v: (model.accuracy[0][i], model.accuracy[1][i], VOTERS[model.parents[i]] if model.parents[i] >= 0 else None) for i, v in enumerate(VOTERS)
        }
        rows = [
            r for df in (seen, labelled) for r in smallest_hashes(df.select("key", "votes", "counts"), "key", SAMPLE_ROWS, "votes", "counts").select("votes", "counts").collect()
        ]
        weights = fit_classifier(inputs_of(np.array([r["counts"] for r in rows], float)), posteriors[[r["votes"] for r in rows]])
    return Toxicity(lexicon, weights, posteriors, learned), seen


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, score, predicted, votes, posterior) for every document."""
    model, seen = fit_toxicity(docs, labels, learn, key, text, label)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(_counts(batch.column(2)))
            v = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column(1), pa.array(model.posteriors[v])],
                names=["key", "score", "predicted", "votes", "posterior"],
            )

    kind = f"key {seen.schema['key'].dataType.simpleString()}, score double, predicted int, votes long, posterior double"
    return seen.mapInArrow(classify, kind)


def keep_clean(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text))], names=["text"])
            low = [shared.value.scores(shared.value.lexicon.counts(c.column(0))) < threshold for c in text_chunks(iter([texts]))]
            if low:
                yield batch.filter(pa.array(np.concatenate(low)))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return scored.select(F.col("key").alias("doc_id"), F.coalesce(held_out("key", 5, 0), F.lit(False)).alias("held_out"), "score", "predicted", "posterior")
