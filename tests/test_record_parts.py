"""Records over the budget: parts within it, told by their heads, and the record back from them."""

import time
import random

import pytest
from pyspark.sql import functions as F

from tabletext.operators import record_parts as rp
from tabletext.operators.documents import TokenCounts


def tokens(text):
    return TokenCounts(text)(0, len(text))


def back(lines):
    return "".join(("" if i == 0 or goes_on else "\n") + s for i, (s, goes_on) in enumerate((s, g) for _, _, s, g in lines if s is not None))


def texts(lines):
    out = {}
    for part, text, _, _ in lines:
        out.setdefault(part, []).append(text)
    return ["\n".join(v) for _, v in sorted(out.items())]


def check(title, body, repeats, budget=400):
    lines = rp.record_parts(title, body, repeats, budget)
    parts = texts(lines)
    assert back(lines) == "\n".join(body)
    assert all(tokens(p) <= budget for p in parts), max(map(tokens, parts))
    return parts, lines


def test_short_records_stay_whole():
    parts, _ = check("## A", ["- a: 1", "- b: 2"], ["- a: 1"])
    assert parts == ["## A\n- a: 1\n- b: 2"]


def test_parts_repeat_who_they_are():
    body = ["- 管理No: K-1", "- 日付: 2026-04-01", "- 内容: " + "異音がした。" * 200, "- 対応の時系列:", *[f"  {i}. 点検して部品を交換した" for i in range(80)], "- 出典: a.csv"]
    parts, lines = check("## 【K-1】異音", body, body[:2])
    n = len(parts)
    assert n > 3 and parts[0].startswith(f"## 【K-1】異音（1/{n}）\n- 管理No: K-1")
    for i, p in enumerate(parts[1:], 2):
        assert p.startswith(f"## 【K-1】異音（続き{i}/{n}）\n- 管理No: K-1\n- 日付: 2026-04-01\n")
    assert any("\n- 内容（続き）: 異音" in p for p in parts) and any("\n- 対応の時系列（続き）:\n  " in p for p in parts)
    # greedy: no part and the lines that follow it would have fitted together
    assert n <= sum(tokens(x) for x in body) / (400 - 60) + 2


def test_bullets_stay_together_where_they_fit():
    body = [x for i in range(12) for x in (f"- 項目{i}:", *["  " + "値" * 40 for _ in range(3)])]
    parts, _ = check("## T", body, [])
    assert all(p.split("\n")[1].startswith("- 項目") and "（続き）" not in p.split("\n", 1)[1] for p in parts)


@pytest.mark.parametrize("seed", range(30))
def test_any_record(seed):
    rng = random.Random(seed)
    words = ["異常なし、", "交換。", "abc ", "x" * 70, "12345", "値", "。", "note: ", "é", "- ", "  "]
    def text(n):
        return "".join(rng.choice(words) for _ in range(rng.randrange(n)))
    body = []
    for i in range(rng.randrange(1, 30)):
        body.append(rng.choice([f"- 項{i}: {text(300)}", f"- {text(60)}:", f"{text(40)}", f"- {text(30)}: {text(30)}", "- "]))
        body += ["  " + text(rng.choice([5, 400])) for _ in range(rng.choice([0, 0, 3, 40]))]
    body = [x.replace("\n", "") for x in body]
    check("## " + text(30)[:190], body, rng.sample(body, min(3, len(body))), rng.choice([400, 400, 700]))


def test_many_parts_widen_the_number():
    parts, _ = check("## T", ["- a: " + "字" * 40_000], ["- k: 1"])
    assert len(parts) > 100 and parts[-1].startswith(f"## T（続き{len(parts)}/{len(parts)}）")


def test_long_repeats_are_shortened_or_left_out():
    body = ["- 管理No: " + "K" * 500, "- " + "名" * 300 + ": x", "- 内容: " + "あ" * 900]
    _, lines = check("## " + "題" * 190, body, body[:2])
    assert all(len(text) < 220 for _, text, source, _ in lines if source is None)


def test_as_columns(spark):
    rows = [(1, "## A", ["- a: 1"], ["- a: 1"]), (2, "## B", ["- a: 1", "- t: " + "長い文。" * 300], ["- a: 1"]), (3, None, None, None), (4, "## D", [], [])]
    df = rp.split_records(spark.createDataFrame(rows, "i int, title string, body array<string>, again array<string>"), "title", "body", "again")
    got = {r["i"]: r for r in df.select("i", rp.part_texts("lines").alias("p"), rp.restored("lines").alias("r"), "body").collect()}
    assert got[1]["p"] == ["## A\n- a: 1"] and got[3]["p"] == [""] and got[4]["p"] == ["## D"]
    assert len(got[2]["p"]) > 2 and all(tokens(p) <= 400 for p in got[2]["p"])
    assert all((g["r"] or "") == "\n".join(g["body"] or []) for g in got.values())
    assert df.where(F.size("lines") > 3).count() == 1


def test_weights_of_short_texts_and_parts_as_runs(spark):
    """Weights by counting equal the running sums, and the texts of parts take one pass over the lines."""
    for t in ["", "a1b22", "①０é日本", "x-[`{~!/:@\n\t\x00\x7f\x80", "😀12,345.6", "9" * 2001]:
        assert rp.weight(t) == TokenCounts(t).sums[-1]
    rows = [(1, [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "e")]), (2, [(1, "x")])]
    df = spark.createDataFrame(rows, "k int, lines array<struct<part:int,text:string>>")
    assert {r["k"]: r["t"] for r in df.select("k", rp.part_texts("lines").alias("t")).collect()} == {1: ["a\nb", "c", "d\ne"], 2: ["x"]}
    # 20,000 lines in 4,000 parts: a pass for each part would be 80 million steps
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct((F.floor(i / 5) + 1).cast("int").alias("part"), i.cast("string").alias("text"))).alias("lines"))
    began = time.monotonic()
    got = many.select(rp.part_texts("lines").alias("t")).first()["t"]
    assert got == ["\n".join(str(5 * k + i) for i in range(5)) for k in range(4000)]
    assert time.monotonic() - began < 10
