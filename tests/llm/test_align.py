import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabletext.llm import align

from .conftest import SF


@pytest.fixture(scope="module")
def sides():
    whole = Tokenizer.from_file(align.MODEL_A)
    whole.encode_special_tokens = True
    return whole, sp.SentencePieceProcessor(model_file=align.MODEL_B)


def spelled(a, b, ids_a, ids_b):
    """Bytes of each token, by the tokenizers' own names of the ids."""
    letters = align._byte_letters()
    left = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    return left, right


def plain(rows, sides):
    """The contract token by token: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row."""
    a, b = sides
    found = []
    for key, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        left, right = spelled(a, b, ids_a, ids_b)
        if not text or b"".join(left) != f" {text}".encode() or b"".join(right) != f" {text}".encode():
            found.append((key, [], [], [], []))
            continue
        ends = [list(np.cumsum([len(x) for x in side]).tolist()) for side in (left, right)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for end in both:
            u = [k for k, e in enumerate(ends[0]) if k >= i and e <= end]
            v = [k for k, e in enumerate(ends[1]) if k >= j and e <= end]
            groups.append(([ids_a[k] for k in u], [ids_b[k] for k in v]))
            i, j = i + len(u), j + len(v)
            for p in u:
                for q in v:
                    if max(ends[0][p] - len(left[p]), ends[1][q] - len(right[q])) < min(ends[0][p], ends[1][q]):
                        links.append((ids_a[p], ids_b[q]))
        found.append((key, ids_a, ids_b, groups, links))
    count = collections.Counter(p for *_, links in found for p in set(links))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for key, ids_a, ids_b, groups, links in found:
        shown = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha256"]


def test_against_plain_counterpart(spark, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 4000).orderBy("doc_id").limit(60).collect()]
    rng = random.Random(13)
    letters = "ab Zé漢́😀\n\t'sll't 0189.,<s></s>▁<|endoftext|><0x41> "
    rows += [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(2000, ""), (2001, None), (2002, " "), (2003, "   a   b "), (2004, "<|endoftext|> </s> <unk>"), (2005, "a" * 5000), (2006, "▁x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = align.align(docs).documents.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr) == plain(rows, sides)


def test_chunks_share_their_counts(spark, sides, monkeypatch):
    """Many small chunks give what one gives; pairs tell their best partners on both sides."""
    rows = [(i, f"the cat {i % 3} and the dog{'s' * (i % 2)} internationalization") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = align.align(docs, groups=True)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.documents.collect()), key=repr) == plain(rows, sides)
    pairs = found.pairs.collect()
    for side in ("a", "b"):
        top = collections.defaultdict(int)
        for r in pairs:
            top[r[side]] = max(top[r[side]], r["docs"])
        assert all(r[f"best_{side}"] == (r["docs"] == top[r[side]]) for r in pairs)
    row = found.documents.where("key = 0").first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["sha256"] and row["groups"].count("|") == row["n_groups"]


def test_ranks_give_the_ids_of_the_library(sides):
    side = align.byte_side(align.MODEL_A)
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), 32, 10])) for _ in range(rng.randrange(1, 80))) for _ in range(500)]
    assert side.encode(texts) == [sides[0].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("which", ["edge_docs", "no_docs"])
def test_edges(request, which):
    docs = request.getfixturevalue(which)
    found = align.align(docs).documents
    assert found.count() == docs.count()
    if which == "edge_docs":
        rows = {r["key"]: r for r in found.collect()}
        assert (rows[0]["n_a"], rows[0]["sha256"], rows[1]["n_links"]) == (0, "", 0) and rows[2]["n_a"] > 0
        assert rows[5]["n_a"] == 0  # its mark U+2581 is spelled as a space
        assert rows[6]["sha256"] == rows[7]["sha256"] and rows[6]["n_links"] > 3000 and rows[None]["n_a"] == 4
