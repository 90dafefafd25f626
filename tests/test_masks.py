"""People and personal data on texts as they are written."""

import ahocorasick
import pytest
from pyspark.sql import functions as F

from tabletext.functions.places import normalized_places
from tabletext.operators import masks, people
from tabletext.plans import record_queries

ALL = ("email", "phone", "amount", "person")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b@x.co.jp へ", [("a.b@x.co.jp", "email")]),
        ("電話 03-1234-5678 2026", [("03-1234-5678", "phone")]),
        ("(03)1234-5678、0120-123-456", [("(03)1234-5678", "phone"), ("0120-123-456", "phone")]),
        ("09012345678 と +81 90-1234-5678", [("09012345678", "phone"), ("+81 90-1234-5678", "phone")]),
        ("内線：１２３４ ext. 55", [("内線：１２３４", "phone"), ("ext. 55", "phone")]),
        ("型番 P-03-1234-5678、2026-04-01、1-2-3", []),
        ("¥1,200 と 3.5万円 と 20 円", [("¥1,200", "amount"), ("3.5万円", "amount"), ("20 円", "amount")]),
        ("￥１，２００", [("￥１，２００", "amount")]),
        ("㈱ﾊﾞﾝﾄﾞｳの坂東さん", [("ﾊﾞﾝﾄﾞｳ", "person"), ("坂東", "person")]),
        ("tanaka@x.jp tanaka", [("tanaka@x.jp", "email"), ("tanaka", "person")]),
        ("", []),
        (None, None),
    ],
)
def test_places(spark, text, want):
    index = people.people_index(spark, registered=[{"name": "坂東", "aliases": ["バンドウ", "tanaka"]}])
    row = masks.find_masks(spark.createDataFrame([(text,)], "t string"), "t", ALL, index).withColumn("m", masks.masked("t")).first()
    got = None if row["masks"] is None else [(text[s["start"] : s["end"]], s["kind"]) for s in row["masks"]]
    assert got == want
    if text is not None:
        out, at = "", 0
        for s in row["masks"]:
            out, at = out + text[at : s["start"]] + masks.WORDS[s["kind"]], s["end"]
        assert row["m"] == out + text[at:]


def test_normalized_places():
    plain, starts, ends = normalized_places("a㈱ﾎﾟ½é漢")
    assert plain == "a(株)ポ1⁄2é漢" and starts == [0, 1, 1, 1, 2, 4, 4, 4, 5, 6] and ends == [1, 2, 2, 2, 4, 5, 5, 5, 6, 7]
    plain, starts, ends = normalized_places("e\u0301漢")
    assert (plain, starts, ends) == ("é漢", [0, 2], [2, 3])


def test_index_and_several_automata(spark, monkeypatch):
    names = spark.createDataFrame([("佐藤 一、佐藤 二",), ("ｽｽﾞｷさん/不明",), (None,), ("長い長い長い長い名前の会社",)], "who string")
    index = people.people_index(spark, names, [{"name": "田中 三", "aliases": ["タナ"]}], ["電気課"])
    forms = {r["form"]: (r["name"], r["kind"], r["people"], r["loose"]) for r in index.collect()}
    assert forms["佐藤"] == ("佐藤", "surname", 2, False) and forms["佐藤一"] == ("佐藤 一", "name", 1, False)
    assert forms["スズキ"][3] and forms["タナ"] == ("田中 三", "alias", 1, False) and forms["電気課"] == ("電気課", "group", 1, True) and "不明" not in forms
    texts = spark.createDataFrame([(["佐藤一が", "スズキ製", "スズキ 電気課"],), (None,), ([None, ""],)], "t array<string>")
    whole = people.find_people(texts, "t", index).select(F.col("people_found").alias("f")).collect()
    assert [[m["form"] for m in x] for x in whole[0]["f"]] == [["佐藤一"], [], ["スズキ", "電気課"]] and whole[1]["f"] is None and whole[2]["f"] == [[], []]
    monkeypatch.setattr(people, "MAX_FORMS", 2)
    assert people.find_people(texts, "t", index).select(F.col("people_found").alias("f")).collect() == whole
    assert people.find_people(texts, "t", people.people_index(spark)).first()["people_found"] == [[], [], []]
    with pytest.raises(ValueError, match="unknown"):
        masks.find_masks(names, "who", ("name",))


def test_overlapping_forms_are_taken_from_the_left():
    """A form does not overlap itself, and a person behind an address counts although a form inside the address overlaps it."""
    automaton = ahocorasick.Automaton()
    for form in ("enen", "comab", "abcd"):
        automaton.add_word(form, (form, form, "name", 1, form == "enen"))
    automaton.make_automaton()
    assert masks.spans_in("thenenen x", ("person",), [automaton]) == []
    assert masks.spans_in("thenen enen x", ("person",), [automaton]) == [(2, 6, "person"), (7, 11, "person")]
    assert masks.spans_in("a@b.com　comabcd", ("email", "person"), [automaton]) == [(0, 7, "email"), (8, 13, "person")]
    # comab starts in the address and is left out, abcd stands behind it
    assert masks.spans_in("a@b.comab", ("email", "person"), [automaton]) == [(0, 9, "email")]
    automaton = ahocorasick.Automaton()
    for form in ("m語", "語abcd"):
        automaton.add_word(form, (form, form, "name", 1, False))
    automaton.make_automaton()
    assert masks.spans_in("a@b.com語abcd", ("email", "person"), [automaton]) == [(0, 7, "email"), (7, 12, "person")]


def test_places_are_found_by_several_tasks(spark):
    """A table of one row group, which one task reads, is dealt out before its texts are searched, once."""
    got = record_queries.mask_places(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_characters_between_runs_keep_their_places():
    """Marks behind characters that stay as they are, at both ends of a run, and marks alone."""
    plain, starts, ends = normalized_places("あがいｶﾞ㈱́z")
    assert plain == "あがいガ(株)́z" and starts == [0, 1, 3, 4, 6, 6, 6, 6, 8] and ends == [1, 3, 4, 6, 8, 8, 8, 8, 9]
    assert normalized_places("゙漢") == ("゙漢", [0, 1], [1, 2])
