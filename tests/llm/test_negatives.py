import random

import numpy as np
import pytest

from tabletext.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50):
    """(anchor, positive, rank, negative, positive score, negative score) by scoring all pairs."""
    kept = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(object), label) for k, v, label in rows if k is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))
    out = []
    for k, v, label in kept:
        if k % every:
            continue
        scored = [(-score(v, w), j, m) for j, w, m in kept if j != k and len(w) == len(v)]
        near = sorted((s, j) for s, j, m in scored if m == label)[:5]
        for s, j in near:
            fit = sorted((t, i) for t, i, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(k, j, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in negatives.mine_negatives(spark.createDataFrame(rows, schema)).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_ROWS", 100)  # several rows of the file
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 4)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(7)], rng.randrange(4)) for i in range(500)]
    rows += [(500 + i, [float(rng.randrange(3)) for _ in range(7)], rng.randrange(3)) for i in range(200)]  # ties
    rows += [(800 + i, [-1.0, *[0.0] * 6], 5) for i in range(3)] + [(900, [0.0] * 7, 7), (901, [0.0] * 7, 7), (950, [1.0], 1), (951, [2.0], 1), (952, [1.5], 2)]
    assert mined(spark, rows) == brute(rows) != []


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (50, None, 1), (None, [1.0, 2.0], 1), (100, [1.0, None], 1), (150, [nan, 1.0], 1), (200, [inf, 1.0], 2), (250, [1.0, 1.0], None),
        (300, [], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, [1e30, 1.0], 1), (350, [1.0, 2.0, 3.0], 1), (4, [0.5, 1.5], 2), (5, [0.5, 1.5], 3),
    ]
    want = brute([r for r in rows if r[0] != 3])
    assert mined(spark, rows) == want != []
    assert mined(spark, [*rows, *rows]) == want  # repeated rows count once
    extra = [(*r, "x", 3) for r in rows]
    assert mined(spark, extra, SCHEMA + ", dim string, part int") == want
    assert mined(spark, []) == []


@pytest.mark.parametrize("clustered", [True, False])
def test_bounds_hold_and_prune(clustered):
    rng = np.random.Generator(np.random.PCG64(1))
    centres = rng.normal(0, 60, (20, 64))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 8, (4000, 64)) if clustered else rng.normal(0, 40, (4000, 64))).round().astype(np.int64)
    one = negatives.approximate(np.arange(4000), rng.integers(0, 10, 4000), vectors)
    scored = 0
    for q in vectors[:40]:
        low, high = -one.reach(-q), one.reach(q)
        exact = vectors @ q
        assert (low <= exact).all() and (exact <= high).all()
        window = int(exact.max() * 0.5), int(exact.max() * 0.9)
        (best,), n = one.best(q, np.arange(4000), [window], 3)
        (first,), _ = one.best(q, np.arange(4000), [(None, None)], 5)
        assert first.tolist() == [[i, -s] for s, i in sorted((-s, i) for i, s in enumerate(exact.tolist()))[:5]]
        inside = sorted((-s, i) for i, s in enumerate(exact.tolist()) if window[0] <= s <= window[1])[:3]
        assert best.tolist() == [[i, -s] for s, i in inside]
        scored += n
    assert scored < 0.02 * 40 * 4000


def test_constant_components():
    vectors = np.array([[3, 0, 5], [3, 0, -5], [3, 0, 7]], np.int64)
    one = negatives.approximate(np.arange(3), np.zeros(3, np.int64), vectors)
    q = np.array([1, 2, -3])
    low, high = -one.reach(-q), one.reach(q)
    assert (low <= vectors @ [1, 2, -3]).all() and (high >= vectors @ [1, 2, -3]).all()
