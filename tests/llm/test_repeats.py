import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabletext.llm import repeats


def brute(rows, window=35):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["key"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "a"] * 4 + [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (34, 35, 36, 50, 80, 120)]
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(4)
            text += p[a:] + [rng.choice(words) for _ in range(rng.randrange(30))]
        if k % 7 == 0:
            text += ["run"] * rng.randrange(30, 90)
        if k % 9 == 0:
            text += ["ab", "cd"] * rng.randrange(10, 40)
        rows.append((k, " ".join(text)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(repeats.remove_repeats(df)) == brute(rows)


def test_regular_words_do_not_collide(spark):
    """Windows that differ by a Thue-Morse word and its swap, and passages that do by such sequences of words, are different."""
    line = lambda a, b, n: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    head = " ".join(f"h{i}" for i in range(34))
    rows = [(1, f"{head} {line('a', 'b', 1024)}"), (2, f"{head} {line('b', 'a', 1024)}")]
    assert [r[2] for r in result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))] == [0, 0]
    rows += [(3, line("a ", "b ", 2048)), (4, line("b ", "a ", 2048) + "c")]
    assert result(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_clashing_columns(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a {shared}", 1, "x", 2), (2, shared, 3, "y", 4)], "doc_id long, text string, key int, found string, cut int")
    assert {r["key"]: r["n_removed"] for r in repeats.remove_repeats(df).collect()} == {1: 40, 2: 40}


def test_anchor_depends_on_window_only():
    rng = np.random.Generator(np.random.PCG64(5))
    inner = rng.integers(1, 40, 35).astype(np.uint64)
    seen = set()
    for _ in range(30):
        left, right = (rng.integers(1, 40, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        names = np.concatenate([left, inner, right])
        starts, name, where, found = repeats.anchors(names, np.zeros(len(names), np.int64))
        i = int(np.flatnonzero(starts == len(left))[0])
        seen.add((int(name[i]), int(where[i]) - len(left), int(found[i])))
    assert len(seen) == 1


def test_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert result(repeats.remove_repeats(edge_docs)) == brute(rows)
    assert repeats.remove_repeats(no_docs).collect() == []


def test_kept_text(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"before {shared} after"), (2, f"other\n{shared}")], "doc_id long, text string")
    kept = {r["key"]: r["kept"] for r in repeats.remove_repeats(df, with_text=True).collect()}
    assert kept == {1: "before after", 2: "other"}
