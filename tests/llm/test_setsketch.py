import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabletext.llm import setsketch


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r\v\f", "abcdefghijklmnopqrstuvwxyz     "))
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """(key, size of the set, smallest key of the component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 85 * len(a | b)] for a in sets]
    out = []
    for i, (key, _) in enumerate(rows):
        met, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - met
            met |= new
            todo += new
        out.append((key, len(sets[i]), min(rows[j][0] for j in met)))
    return sorted(out)


def edited(rng, base, n):
    copy = list(base)
    for _ in range(n):
        i = rng.randrange(max(1, len(copy)))
        copy[i : i + 1] = rng.choice([[], ["new"], [*copy[i : i + 1], "more"]])
    return copy


def test_against_brute_force(spark):
    rng, rows = random.Random(12), []
    words = [f"w{i}" for i in range(300)]
    for k in range(50):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 10, 15, 30, 60, 150, 400]))]
        for n in [0, *[rng.randrange(6) for _ in range(rng.randrange(4))]]:
            text = " ".join(edited(rng, base, n))
            rows.append((len(rows), text.upper() if k % 2 else text))
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["key"], r["n_shingles"], r["component"]) for r in found) == brute(rows)


def test_chains_and_families(spark):
    """Copies of one text beside a chain whose ends are not linked, in groups of several blocks."""
    rng = random.Random(4)
    base = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, " ".join(edited(rng, base, 3))) for i in range(60)]
    chain = [f"d{i}" for i in range(100)]
    for i in range(40):
        rows.append((200 + i, " ".join(chain)))
        chain[3 * (i % 30)] = f"e{i}"
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["key"], r["n_shingles"], r["component"]) for r in found) == brute(rows)


def test_registers_merge_and_estimate():
    rng = np.random.Generator(np.random.PCG64(3))
    for n, j in ((20, 0.85), (100, 0.7), (1000, 0.9)):
        errors = []
        for _ in range(20):
            common = round(2 * n * j / (1 + j))
            pool = rng.integers(1, 2**62, 2 * n).astype(np.uint64)
            a, b = pool[:n], pool[n - common : 2 * n - common]
            one, two, union = setsketch.sketches_of([a, b, np.union1d(a, b)])
            assert (setsketch.merged(one, two) == union).all()
            more, less = np.array([(one > two).sum()]), np.array([(one < two).sum()])
            found = setsketch.likeliest(more, less, setsketch.REGISTERS - more - less, n, np.array([n]))[0]
            errors.append(found - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.03


def test_linked_sets_share_bands_and_pass_the_estimate():
    rng = np.random.Generator(np.random.PCG64(9))
    for size in [*range(6, 40), 100, 500, 3000]:
        for _ in range(10 if size < 100 else 3):
            gone = max((g for g in range(size) if 100 * (size - g) >= 85 * (size + g)), default=0)
            pool = rng.integers(1, 2**62, 2 * size).astype(np.uint64)
            pair = setsketch.sketches_of([pool[:size], pool[gone : size + gone]])
            bands = setsketch.band_values(pair)
            assert (bands[0] == bands[1]).any() and setsketch.may_link(pair[0], pair[1:], size, np.array([size]))[0]
    far = setsketch.sketches_of([pool[:100], pool[60:160]])
    assert not setsketch.may_link(far[0], far[1:], 100, np.array([100]))[0]
    assert not setsketch.registers(np.zeros(0, np.uint64), np.array([0, 0])).any()


@pytest.mark.parametrize("which", ["edge_docs", "no_docs"])
def test_edges(request, which):
    docs = request.getfixturevalue(which)
    found = {(r["key"], r["component"], r["n_shingles"]) for r in setsketch.near_duplicates(docs).collect()}
    keys = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {k for k, _, _ in found} == keys
    if which == "edge_docs":
        assert {(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 1), (None, None, 2), (7, 6, 2998), (9, 8, 5)} <= found
        assert docs.count() == setsketch.near_duplicates(docs).where(F.col("n_shingles").isNotNull()).count()
