"""Personal data, toxicity, quality, SentencePiece."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabletext.llm import pii, quality, sentencepiece, toxicity

SF = "/root/testdata/sf0.01"


def plain_base(text):
    """The base rules as they are stated, with plain patterns."""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


CASES = [
    "", "a@b.c", "x@@y.z a.b@c-d.e.f", "@a.b x@y x@y.", "me@host.com@other.org", "1.2.3.4.5.6.7.8", "1.2.3.999 255.255.255.255 0001.2.3.4", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "4111111111111112", "+1 (555) 123-4567", "+1 555", "++49 30 1234567890 tel", "+5-5-5+1 555 123 45678",
    "tel +44 20 7946 0958, mail jo.doe@x.co.uk; ip 10.0.0.1:80", "5" * 40, "9" * 16, "ü@b.de ü1.1.1.1",
]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(0)
    for text in CASES + ["".join(rng.choice("a1.@+-() 9%é") for _ in range(rng.randrange(60))) for _ in range(3000)]:
        assert pii.base_spans(text) == plain_base(text), text


def test_field_learns_and_decodes():
    texts = [f"call +{i % 9 + 1} 555 {100 + i} {2000 + i} now" for i in range(80)] + [f"room {i} has {i * 3} chairs" for i in range(80)]
    field = pii.Field(np.zeros((5, pii.N_FEATURES)))
    data = [island for t in texts for _, island in pii.training_islands(t)]
    assert any(y for _, _, gold in data for _, _, y in gold) and any(all(y == 0 for _, _, y in gold) for _, _, gold in data)
    # the gradient agrees with differences of the log-likelihood
    n, segs, gold = next(d for d in data if any(y for _, _, y in d[2]))
    rng = np.random.Generator(np.random.PCG64(0))
    field.weights, field.steps = rng.normal(size=field.weights.shape), rng.normal(size=field.steps.shape)

    def likelihood(f):
        import itertools

        scores, total, best = f.scores(segs), [], None
        def walk(at, last, value, path):
            if at == n:
                total.append((value, tuple(path)))
                return
            for j in range(at + 1, min(n, at + pii.MAX_TOKENS) + 1):
                for y in range(5):
                    s = scores[at, j][y] + (f.steps[last, y] if last is not None else 0)
                    if np.isfinite(s):
                        walk(j, y, value + s, [*path, (at, j, y)])
        walk(0, None, 0.0, [])
        return next(v for v, p in total if p == tuple(gold)) - np.logaddexp.reduce([v for v, _ in total]), max(total)[1]

    base, best = likelihood(field)
    assert tuple(field.best(n, segs)) == best
    dw, ds = field.gradient(n, segs, gold)
    for where, d in ((field.weights, dw), (field.steps, ds)):
        for i in [(1, 0), (4, 3), (0, 0)]:
            where[i] += 1e-5
            assert (likelihood(field)[0] - base) / 1e-5 == pytest.approx(d[i], abs=1e-3)
            where[i] -= 1e-5


def test_pii_keeps_base_and_redacts(spark, edge_docs, no_docs):
    rows = [(i, f"write jo{i}@mail.example.com or +44 20 7946 {1000 + i} today") for i in range(50)] + [(99, "number 030 7946 1234 567 here"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find_pii(df, redact=True).collect()}
    assert out[100]["text"] is None and out[100]["base_spans"] == []
    for i, text in rows[:50]:
        assert [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in out[i]["base_spans"]] == plain_base(text)
        assert {tuple(s) for s in out[i]["base_spans"]} <= {tuple(s) for s in out[i]["pii_spans"]}
        assert "@" not in out[i]["redacted"] and "[EMAIL]" in out[i]["redacted"]
    assert pii.find_pii(edge_docs).count() == edge_docs.count()
    assert pii.find_pii(no_docs).count() == 0


def test_pii_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        base = [(s["start"], s["end"], pii.KINDS.index(s["kind"])) for s in r["base_spans"]]
        assert base == plain_base(texts[r["doc_id"]])
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["pii_spans"]}


def _accuracy(rows, truth):
    pairs = [(r["score"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and r["held_out"]]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_long_islands_are_cut_between_spans():
    text = " ".join(["a1"] * 23 + ["+49 30 1234 5678"] + ["b2"] * 60)
    found = list(pii.training_islands(text))
    assert sum(n for _, (n, _, _) in found) == 87 and all(n <= pii.ISLAND_TOKENS + pii.MAX_TOKENS for _, (n, _, _) in found)
    assert sum(inside for inside, _ in found) == 1


def test_words_are_runs_of_letters():
    lexicon = toxicity.Lexicon(["brüll"], ["disgustibl"])
    texts = pa.array(["you “idiot” «IDIOT» idiot—ic", "BRÜLLEND brüll’s x漢字y", "1d10t st00ge stup1d", "idio", "", "disgusti disgustible disgusting " + "a" * 5000])
    counts = dict(zip(toxicity.COUNTS, lexicon.counts(texts).T.tolist(), strict=True))
    assert counts["seed"] == [3, 0, 0, 0, 0, 1] and counts["firm"] == [0, 2, 0, 0, 0, 0] and counts["loose"] == [0, 0, 0, 0, 0, 1]
    assert counts["leet"] == [0, 0, 1, 0, 0, 0] and counts["addressed"] == [1, 0, 0, 0, 0, 0] and counts["shouted"][0] == 1
    assert counts["words"] == [5, 4, 6, 1, 0, 4]
    assert [sorted(x) for x in toxicity._stems(pa.array(["«Üben» ab", None]))] == [["übe", "üben"], []]


def test_quality_against_plain_equations(spark):
    """Normal equations and scores as plain numpy computes them from the same statistics."""
    rng = np.random.Generator(np.random.PCG64(4))
    stats = rng.normal(size=(300, len(quality.STATISTICS))).astype(np.float32)
    y = (stats[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y, strict=True)], "stats array<float>, y double").repartition(5)
    mapping = quality.FourierMap(np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    zz, zy = quality.normal_equations(df, mapping)
    z = mapping(stats.astype(float))
    assert np.allclose(zz, z.T @ z, atol=0.2) and np.allclose(zy, z.T @ y, atol=0.2)
    again = quality.normal_equations(df.repartition(3), mapping)
    assert (zz == again[0]).all() and (zy == again[1]).all()  # whatever the order of tasks
    wide = rng.standard_normal((20_000, stats.shape[1])) / 4
    kernel = np.exp(-((wide[::2] - wide[1::2]) ** 2).sum(axis=1) / (2 * quality.WIDTH**2))
    d = quality.FEATURES
    near = (mapping(wide[::2])[:, :d] * mapping(wide[1::2])[:, :d]).sum(axis=1)
    assert abs(near - kernel).max() < 0.4 and abs((near - kernel).mean()) < 0.05
    centres, values = quality.isotonic(np.arange(6.0), np.array([0, 0.5, 0.2, 0.9, 0.8, 1]), np.array([1, 1, 1, 1, 3, 1]))
    assert values.tolist() == pytest.approx([0, 0.35, 0.825, 1]) and centres.tolist() == pytest.approx([0, 1.5, 3.75, 5])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold too few toxic documents to learn stems from
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op2_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert _accuracy(rows, truth) > 0.9


def test_quality_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op10_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert _accuracy(rows, truth) > 0.9


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifier_edges(edge_docs, no_docs, labels, score):
    learn = F.lit(True)
    rows = score(edge_docs, labels, learn).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["key"] in (8, 9)}
    assert len(same) == 1
    assert score(no_docs, labels, learn).count() == 0
    assert score(edge_docs, labels.limit(0), learn).count() == edge_docs.count()


def test_label_model_finds_the_accurate_voter():
    rng = np.random.Generator(np.random.PCG64(2))
    y = rng.random(20_000) < 0.2
    bits = np.zeros((len(y), len(toxicity.VOTERS)), int)
    bits[:, 0] = np.where(y, rng.random(len(y)) < 0.9, rng.random(len(y)) < 0.01)
    bits[:, 1] = bits[:, 0] & (rng.random(len(y)) < 0.7)  # hangs on the first
    bits[:, 2] = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.1)
    bits[:, 11] = ~bits[:, :3].any(axis=1)
    votes, counts = np.unique(bits @ (1 << np.arange(bits.shape[1])), return_counts=True)
    model = toxicity.LabelModel(votes, counts.astype(float), np.zeros(len(votes)), np.zeros(len(votes)))
    assert model.accuracy[1][0] > 0.8 and model.accuracy[0][0] < 0.1
    assert sum(p >= 0 for p in model.parents) == len(toxicity.VOTERS) - 1


def best_score(pieces, word):
    """The best segmentation score, over all segmentations."""
    best = {0: 0.0}
    for end in range(1, len(word) + 1):
        options = [best[end - len(p)] + s for p, s in pieces.items() if len(p) <= end and word[end - len(p) : end] == p and end - len(p) in best]
        options.append(best[end - 1] + sentencepiece.BYTE_SCORE)
        best[end] = max(options)
    return best[len(word)]


def test_viterbi_is_the_best_segmentation():
    rng = random.Random(4)
    vocab = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))): -rng.random() * 10 for _ in range(40)}
    vocab = {p: s for p, s in vocab.items() if "▁" not in p[1:] and "c" != p}
    names = [f"<0x{b:02X}>" for b in range(256)]
    coder = sentencepiece.Pieces([(n, 0.0) for n in names] + list(vocab.items()), list(range(256)), prefix=False)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
        ids = coder.viterbi(word)
        score = sum(vocab[coder.names[k]] for k in ids if k >= 256) + sum(sentencepiece.BYTE_SCORE for k in ids if k < 128) + sum(sentencepiece.BYTE_SCORE for k in ids if k == 0xE2)
        assert score == pytest.approx(best_score(vocab, word)), word


TEXTS = ["", " ", "  two  spaces ", "Hello world.\nNew line\ttab", "Grüße 漢字 🙂", "mark ▁ in text", "private  use", "zero \x00 byte", "a" * 300, None, "▁", " ▁\x00"]


def test_round_trip(spark, edge_docs, no_docs):
    coder = sentencepiece.Pieces.load(sentencepiece.MODEL)
    assert coder.decode(coder.encode(pa.array(TEXTS, pa.large_string()))).to_pylist() == TEXTS
    for t in TEXTS[:-1]:
        if t is not None:
            assert coder.decode(coder.encode(pa.array([t], pa.large_string()))).to_pylist() == [t]
    out = sentencepiece.decode(sentencepiece.encode(edge_docs)).collect()
    assert len(out) == edge_docs.count() and all(r["decoded"] == r["text"] for r in out)
    assert sentencepiece.encode(no_docs).count() == 0
