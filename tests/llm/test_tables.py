"""Mixing, media, WARC, top-k and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabletext.llm import media, mixing, topk, warc

SF = "/root/testdata/sf0.001"


def test_poisson_inverse(spark):
    df = spark.range(20_000).select(mixing.poisson_inverse(mixing.unit_hash(F.lit("t"), "id"), F.lit(2.5)).alias("k"))
    row = df.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert row["m"] == pytest.approx(2.5, abs=0.05) and row["v"] == pytest.approx(2.5, abs=0.12)
    edges = spark.sql("SELECT 0.0D AS u, 1.0D AS r UNION ALL SELECT 0.5D, 0.0D").select(mixing.poisson_inverse(F.col("u"), F.col("r")).alias("k"))
    assert [r["k"] for r in edges.collect()] == [0, 0]


def test_mixing_meets_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    targets = spark.createDataFrame([("hot", 1.0), ("s1", 3.0)], "source string, weight double")
    out = mixing.mix_sources(df, weights=targets).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert set(n) == {"hot", "s1"}
    assert n["hot"] == pytest.approx(7500, rel=0.05) and n["s1"] == pytest.approx(22500, rel=0.05)
    assert mixing.mix_sources(df, weights=targets).collect() == mixing.mix_sources(df.repartition(7), weights=targets).collect()


def test_mixing_large_rate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, source string")
    assert mixing.mix_sources(df, size=1500.0).count() == pytest.approx(3000, rel=0.1)


def test_mixing_edges(edge_docs, no_docs):
    out = mixing.mix_sources(edge_docs.withColumn("copy", F.lit("own")), size=20.0)
    assert {r["source"] for r in out.collect()} == {None, "src0"}
    assert mixing.mix_sources(no_docs).count() == 0


HTML = """<html><head><title>no</title></head><body><p>One <b>two</b></p><figure><img src="sha256:AB" alt="alt"><img src="x.png" alt="only alt">
<figcaption>Both &amp; more</figcaption></figure>tail<video src="v.mp4"></video><audio><source src="sha256:cd"></audio><script>x<y</script><p>end"""


def test_sequence():
    items = media.sequence(HTML)
    assert [(i["kind"], i["text"], i["ref"], i["digest"], i["caption"]) for i in items] == [
        ("text", "One two", None, None, None),
        ("image", None, "sha256:AB", "ab", "Both & more"),
        ("image", None, "x.png", None, "Both & more"),
        ("text", "tail", None, None, None),
        ("video", None, "v.mp4", None, None),
        ("audio", None, "sha256:cd", "cd", None),
        ("text", "end", None, None, None),
    ]
    assert [i["position"] for i in items] == list(range(7))
    assert media.sequence("") == [] and media.sequence("<p><figure><img>")[0]["kind"] == "image"


def test_optional_end_tags():
    found = lambda html: [(i["kind"], i["text"], i["caption"]) for i in media.sequence(html)]
    assert found("<html><head><title>t</title><body><p>Hello</p><img src=a>") == [("text", "Hello", None), ("image", None, None)]
    assert found("<head><title>t</title><style>p{}</style><p>x") == [("text", "x", None)]
    assert found("<figure><img src=a><figcaption>c</figure><p>after") == [("image", None, "c"), ("text", "after", None)]
    assert found("<figure><figcaption>c<p>d<img src=a></figure>z<img src=b>") == [("image", None, "c d"), ("text", "z", None), ("image", None, None)]
    assert found("<p>a<figcaption>lone") == [("text", "a", None), ("text", "lone", None)]


def test_given_pages_keep_their_words(spark):
    """Every word outside tags, titles, scripts and styles of the given pages is in the items, in order."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    items = {r["page_id"]: r["items"] for r in media.interleave(pages).collect()}
    rows = pages.collect()
    assert len(items) == len({r["page_id"] for r in rows}) and any(i["kind"] == "text" for x in items.values() for i in x)
    for r in rows:
        plain = re.sub(r"(?is)<(script|style|title|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", r["html"] or "")
        words = "".join(unescape(re.sub(r"(?s)<[^>]*>", " ", plain)).split())
        said = "".join("".join((i["text"] or i["caption"] or "").split()) for i in items[r["page_id"]])
        assert words == said, r["page_id"]


def test_documents_as_pages_keep_their_words(spark, edge_docs):
    rows = media.interleave(media.pages_of_texts(edge_docs)).collect()
    for r in rows:
        assert [i["kind"] for i in r["items"]].count("image") == 1
    words = sorted(" ".join(i["text"] for i in r["items"] if i["kind"] == "text") for r in rows)
    assert words == sorted(" ".join((r["text"] or "").split()) for r in edge_docs.collect())


def test_media_and_warc_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert media.op5_media(spark, str(tmp_path)).collect() == [] and warc.op6_warc(spark, str(tmp_path)).collect() == []


def test_resolve_keeps_places(spark):
    pages = spark.createDataFrame([(1, HTML, "x"), (2, None, "y"), (3, "<p>a<img data-digest='sha256:ab'>b", "z")], "page_id long, html string, digest string")
    facts = spark.createDataFrame([("ab", 7)], "digest string, size int")
    rows = media.resolve(media.interleave(pages), facts, "page_id").orderBy("page_id", "position").collect()
    assert [r["size"] for r in rows if r["page_id"] == 1] == [None, 7, None, None, None, None, None]
    assert [(r["kind"], r["size"]) for r in rows if r["page_id"] == 3] == [("text", None), ("image", 7), ("text", None)]


def test_media_contract(spark, edge_docs, tmp_path):
    path = str(tmp_path / "t")
    edge_docs.select("doc_id", "text").write.parquet(f"{path}/documents.parquet")
    out = media.op5_media(spark, path).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    want = []
    for k, t in texts:
        data = t.encode()
        pad = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        want.append((k, len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert sorted((tuple(r[n] for n in names) for r in out), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        bad = bytearray(media.to_png(b"x" * 192))
        bad[50] ^= 1
        media.from_png(bytes(bad))


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big), (5, "http://b c", big), (3, None, big), (4, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", None), (8, "u", ""), (5, "http://b c", big), (None, "n", big)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op6_warc(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r["error"] is None for r in out)
    for r in out:
        html = next((h for k, _, h in rows if k == r["page_id"]), None) or ""
        assert r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and r["payload_bytes"] == len(html.encode())
        revisit = len(html.encode()) >= 1000 and r["page_id"] != 5
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))


def test_warc_damage():
    a, b, c = (warc.record_bytes("response", f"urn:page:{i}", "u", bytes([65 + i]) * 3000, None) for i in range(3))
    bad = bytearray(b)
    bad[len(b) // 2] ^= 255
    found = list(warc.members(a + bytes(bad) + c))
    assert [e is None for _, _, e in found][0] and found[-1][2] is None and any(e for _, _, e in found)
    assert warc.parse_record(found[0][1])["payload"] == b"A" * 3000
    assert list(warc.members(a[:-20]))[0][2] == "gzip member cut off"
    data = list(warc.members(a))[0][1]
    assert warc.parse_record(data.replace(b"AAAA", b"AAAB", 1))["error"] == "block digest does not match"
    assert warc.parse_record(data[:-10])["error"] == "block does not match Content-Length"
    assert warc.parse_record(b"junk")["error"] == "no WARC header"


def brute_top(rows, every, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(np.isfinite(v)):
            vectors.setdefault((i, tuple(v)), [int(np.floor(1024.0 * float(x))) for x in v])
    out = set()
    for (q, _), a in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for (i, _), b in vectors.items() if i != q and len(a) == len(b))
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.Generator(np.random.PCG64(9))
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(100)]  # ties
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1004, []), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.top_k(df, every=20, k=5).collect()
    assert {tuple(r) for r in found} == brute_top(rows, 20, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_prunes_clusters(spark, monkeypatch):
    """Of vectors in clusters, queries see few of the other groups, and the answer stays exact."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 50)
    seen = []
    plain = topk.open_groups
    monkeypatch.setattr(topk, "open_groups", lambda q, b, p: seen.append((plain(q, b, p), q.count() * (b.count() - 1))) or seen[-1][0])
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.05 * rng.normal(size=16)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {tuple(r) for r in topk.top_k(df, every=50, k=5).collect()}
    assert found == brute_top(rows, 50, 5)
    asked, possible = seen[0][0].count(), seen[0][1]
    assert asked < 0.3 * possible, (asked, possible)


def test_topk_exact_beyond_doubles():
    big = float(2**40)
    ids, v = np.array([1, 2]), np.array([[big, 1.0], [big, 2.0]])
    found = topk.search(ids, v, np.array([0]), np.array([[2.0**20, 1.0]]), np.array([None], object), 2)
    assert [(i, s) for _, i, s in found] == [(2, 2**60 + 2), (1, 2**60 + 1)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "PII", "mixing sources", "SentencePiece"]
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["round_trip"] for r in out)
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}


def test_pipeline_stages_on_edges(spark, edge_docs):
    docs = edge_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            stage(spark, d, SF).collect()
