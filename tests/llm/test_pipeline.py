"""The stages of the pipeline, each against a plain version on its own input."""

import hashlib
import math

import pytest

import corpus_pipeline
from tabletext.llm import pii, sentencepiece, toxicity
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, out[-1], SF)
        out.append(spark.createDataFrame(done.collect(), done.schema))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[:-1])


def test_toxic_documents_go(spark, stages):
    scored = toxicity.score_toxicity(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out("doc_id", 5, 0))
    assert set(rows(stages[1])) == {r["key"] for r in scored.collect() if r["predicted"] == 0}


def test_one_of_each_group_stays(stages):
    before = rows(stages[1])
    found = brute([(k, r["text"]) for k, r in sorted(before.items())])
    assert set(rows(stages[2])) == {k for k, n, c in found if k == c}
    assert all(before[k] == r for k, r in rows(stages[2]).items())


def test_personal_data_is_replaced(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for k, r in after.items():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        if not any(c.isdigit() or c == "@" for c in before[k]["text"]):
            assert r["text"] == before[k]["text"]


def test_copies_are_poisson(stages):
    before = stages[3].collect()
    size = {}
    for r in before:
        size[r["source"]] = size.get(r["source"], 0) + 1
    total = sum(math.sqrt(n) for n in size.values())
    want = {}
    for r in before:
        rate = math.sqrt(size[r["source"]]) / total * len(before) / size[r["source"]]
        u = int(hashlib.md5(f"mix:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        want[r["doc_id"]] = k
    got = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_ids_spell_the_texts(stages):
    coder = sentencepiece.Pieces.load(sentencepiece.MODEL)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    out = stages[5].collect()
    assert len(out) == stages[4].count()
    spelled = lambda ids: b"".join(bytes([coder.of_byte[k]]) if k in coder.of_byte else coder.names[k].replace("▁", " ").encode() for k in ids).decode()[1:]
    assert all(spelled(r["ids"]) == texts[r["doc_id"]] and r["round_trip"] for r in out)


def test_stages_on_edge_rows(spark, edge_docs, no_docs, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through every stage, and no rows at all."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    given = sorted((r["text"] or "" for r in edge_docs.collect()))
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        if name == "toxicity":
            assert sorted(r["text"] or "" for r in got) == given and docs.columns == corpus_pipeline.COLUMNS
        elif name == "n-gram Jaccard join":
            # the long text and the short one stand once, texts without words all stay
            assert len(got) == len(before) - 3 and sorted(r["text"] or "" for r in got) == sorted([*{r["text"] for r in before if (r["text"] or "").strip()}, *[r["text"] or "" for r in before if not (r["text"] or "").strip()]])
        elif name == "PII":
            assert sorted(map(repr, (r["text"] for r in got))) == sorted(map(repr, (r["text"] for r in before)))
            assert all((r["n_chars"] is None) == (r["text"] is None) for r in got)
        elif name == "SentencePiece":
            assert len(got) == len(before) and all(r["round_trip"] for r in got)
