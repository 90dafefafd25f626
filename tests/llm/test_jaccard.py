import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabletext.llm import jaccard


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda r: rows[r][0])
                root[y] = x
    return {(rows[i][0], len(s), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i, (_, s) in enumerate(sets)}


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 7, 8, 9, 12, 20, 40, 90, 200]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):  # copies, with edits at and around the threshold
            copy = list(base)
            for _ in range(rng.randrange(5)):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], ["new"], [copy[i], "more"]])
            rows.append((len(rows), " ".join(copy).upper() if k % 2 else " ".join(copy)))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["key"], r["n_shingles"], r["component"]) for r in found} == brute(rows)


def meet(pairs):
    """Whether each pair of neighbours shares the signatures that both need, in some kind of one band."""
    values = np.concatenate([np.sort(np.array(s, np.uint64)) for s in pairs])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in pairs])])
    held = [({}, {}) for _ in pairs]
    for sig, row, kind, need in zip(*[x.tolist() for x in jaccard.signatures(values, offsets)], strict=True):
        held[row][0].setdefault(kind, set()).add(sig)
        held[row][1][kind] = need
    ok = []
    for a, b in zip(held[::2], held[1::2], strict=True):
        ok.append(any(len(x & y) >= max(a[1][i], b[1][j]) for i, x in a[0].items() for j, y in b[0].items() if (i == 2) == (j == 2)))
    return ok


def test_classes_under_one_short_id_keep_their_signatures(spark):
    """One with need 1 and signature 100, one with need 5 and signatures 1 to 5; all are shared with others."""
    rows = [(s, 7, 0, None) for s in (1, 2, 3, 4, 5, 100)] + [(None, 7, 0, 1), (None, 7, 0, 5)] + [(100, 8, 0, None), (None, 8, 0, 1)]
    rows += [(s, 9, 0, None) for s in (1, 2, 3, 4, 5)] + [(None, 9, 0, 5)] + [(100, 10, 0, None), (None, 10, 0, 1)]
    kept = {tuple(r) for r in jaccard.rarest_signatures(spark.createDataFrame(rows, "sig long, short long, kind int, need int")).collect()}
    assert {(100, 7), (100, 8), (100, 10)} <= kept and {s for s, short in kept if short == 9} <= {s for s, short in kept if short == 7}


def test_sets_without_a_division_sign_their_elements(monkeypatch):
    monkeypatch.setattr(jaccard, "DIVISIONS", 1)
    rng = np.random.Generator(np.random.PCG64(5))
    pool = rng.integers(1, 2**62, 40).astype(np.uint64)
    pairs = [x for n in range(3, 32) for x in (pool[:n], pool[: n + 1])]
    assert all(ok or not jaccard.linked(np.array([n]), n, n + 1)[0] for ok, n in zip(meet(pairs), range(3, 32), strict=True))


def test_schemes_enumerate_subsets():
    for band in range(2, 14):
        n1, n2, k2 = jaccard.scheme(band)
        differ = 2 * ((1 << (band + 1)) - 1) // 7
        assert n2 > 2 and 0 < k2 < n2 and n1 * (k2 + 1) > differ  # some part differs in at most k2 cells
    assert jaccard.scheme(1)[0] == 0


def test_linked_sets_share_a_signature():
    rng = np.random.Generator(np.random.PCG64(1))
    pairs = []
    for size in [*range(3, 40), 47, 48, 63, 64, 95, 96, 127, 128, 150, 191, 192, 255, 256, 511, 512, 600]:
        for turn in range(40 if size < 40 else 6):
            pool = rng.integers(1, 2**62, 2 * size + 10).astype(np.uint64)
            for extra in {0, turn % (size // 3 + 1), size // 3}:
                gone = max((g for g in range(size // 4 + 1) if jaccard.linked(np.array([size - g]), size, size + extra)[0]), default=None)
                if gone is None or gone + extra == 0:
                    continue
                pairs += [pool[:size], np.concatenate([pool[gone:size], pool[size : size + gone + extra]])]
    assert len(pairs) > 3000 and all(meet(pairs))


def test_prefixes_of_linked_sets_share_their_need():
    rng = np.random.Generator(np.random.PCG64(7))
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(30 if size < 60 else 5):
            pool = rng.permutation(10 * size + 50)
            for extra in {0, 1, size // 6, size // 3}:
                gone = max((g for g in range(size // 4 + 1) if jaccard.linked(np.array([size - g]), size, size + extra)[0]), default=None)
                if gone is None:
                    continue
                a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[gone:size], pool[size : size + gone + extra]]))
                sizes = np.array([len(a), len(b)])
                n, need = jaccard.prefix_size(sizes), jaccard.prefix_need(sizes)
                assert len(np.intersect1d(a[: n[0]], b[: n[1]])) >= need.max(), (size, extra, gone)


def test_sets_in_few_cells_share_a_signature():
    """Sets that fill few cells of the first division, down to a single one."""
    pairs, rng = [], np.random.Generator(np.random.PCG64(2))
    candidates = rng.integers(1, 2**62, 60_000).astype(np.uint64)
    for size in range(3, 32):
        for ahead in (0, 1):
            n1, n2, _ = jaccard.scheme(int(np.log2(size)) + ahead)
            if not n1:
                continue
            cell = jaccard.mix(candidates ^ np.uint64(0xA5A5A5A5)) % np.uint64(n1 * n2)
            for cells in (1, 2, 3):
                near, other = candidates[cell < cells], candidates[cell >= cells]
                for extra in range(size // 3 + 1):
                    for pool in (near[size:], other):
                        gone = max((g for g in range(size) if jaccard.linked(np.array([size - g]), size, size + extra)[0]), default=None)
                        if gone is not None and gone + extra:
                            pairs += [near[:size], np.concatenate([near[gone:size], pool[: gone + extra]])]
    assert len(pairs) > 1000 and all(meet(pairs))


def thue_morse(a, b, n):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_regular_words_do_not_collide(spark):
    """A Thue-Morse word and its swap, of letters and of words, are different."""
    x, y = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    rows = [(1, f"q w e r {x}"), (2, f"q w e r {y}"), (3, thue_morse("a ", "b ", 4096)), (4, thue_morse("b ", "a ", 4096) + "c")]
    found = {r["key"]: (r["n_shingles"], r["component"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}
    assert found == {1: (1, 1), 2: (1, 2)}
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["key"], r["n_shingles"], r["component"]) for r in found} == brute(rows)


def test_short_hubs_link_all_their_copies(spark):
    """A hub and its copies with words appended are linked through the hub alone, also where it fills few partitions."""
    rows = []
    for hub in range(150):
        base = [f"h{hub}w{i}" for i in range(7 + hub % 3)]  # 3 to 5 shingles; with one word more, 0.75 and above
        rows += [(4 * hub + i, " ".join(base + [f"x{hub}y{i}"] * (i > 0))) for i in range(4)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["key"], r["component"]) for r in found} == {(k, k // 4 * 4) for k, _ in rows}


def test_forest_links_everything_once():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [2, 3, 4, 5], [9, 10, 11], [9, 10, 11, 12], [50])]
    links = jaccard.forest(sets, list(range(6)))
    assert len(links) == 3
    assert {frozenset(x) for x in links} >= {frozenset((3, 4))}
    assert len(jaccard.forest(sets, [0, 0, 1, 2, 2, 3])) == 1  # what is linked already is not compared
    assert {frozenset(x) for x in jaccard.forest(sets, list(range(6)), [True] + [False] * 5)} == {frozenset((0, 1))}


def test_blocks_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 40)
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + f" tail{i}") for i in range(12)]
    rows += [(20 + i, " ".join(f"v{j}" for j in range(i, i + 40))) for i in range(12)]  # a chain: far ends do not link
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["key"], r["component"]) for r in found} == {(k, 20 * (k >= 20)) for k, _ in rows}


def test_edges(edge_docs, no_docs):
    rows = jaccard.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["key"]: r for r in rows}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0
    assert by[7]["component"] == 6 and by[9]["component"] == 8
    assert by[3]["n_shingles"] == 1
    assert jaccard.near_duplicates(no_docs).collect() == []


def test_null_and_repeated_keys(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join(["y", *base]), "other text of seven words in all", "other text of seven words in all more"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[4])]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = sorted((r["n_shingles"], r["component"]) for r in found if r["key"] is not None)
    assert sizes == [(3, 7), (4, 7), (4, 7), (37, 7)]
    assert [r["component"] for r in found if r["key"] is None] == [7, 7]


def test_keep_first(edge_docs, no_docs):
    clashing = {"jaccard_key": "a", "jaccard_cls": "b", "cls": "c", "rep": "d"}
    edge_docs = edge_docs.withColumns({c: F.lit(v) for c, v in clashing.items()})
    kept = jaccard.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns and all(r["cls"] == "c" for r in kept.collect())
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert ids == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 5), (False, 6), (False, 8), (True, 0)]
    assert jaccard.keep_first(no_docs).count() == 0


def test_sets_have_whole_texts():
    same = "x y z u v " * 3
    values, offsets, words, ids = jaccard.shingle_sets(pa.array(["A b c d e f", "a B c d e f", "a b c", "", same + "x y", same + "x"]))
    assert words.tolist() == [6, 6, 3, 0, 17, 16]
    assert np.diff(offsets).tolist() == [2, 2, 1, 0, 5, 5]
    assert ids[0] == ids[1] and ids[4] == ids[5] and len(set(ids)) == 4


def test_window_factors_keep_differences():
    """Sums and differences of the factors of a window, as regular sequences of two words make them, are far from zero."""
    from itertools import product

    from tabletext.llm import common

    for lane in common._FACTORS[:, :5].tolist():
        for signs in product((-1, 0, 1), repeat=5):
            total = sum(a * b for a, b in zip(lane, signs, strict=True)) % 2**64
            assert not any(signs) or total % 2**12
