"""Identifiers, quantities, plans, held-on authors and notes of logs; times of day."""

import pytest
from pyspark.sql import functions as F

from tabletext.functions.values import time_of_day
from tabletext.operators import checks, documents, log_details, logs, people


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f("t").alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "identifiers", "quantities", "plans"),
    [
        ("P-12を5個交換、次回7/1予定", ["P-12"], ["5個"], ["次回7/1予定"]),
        ("N2パージ 5mm No.3 OK2 E1", ["E1"], ["5mm"], []),
        ("×2、¥1,200 3〜5回。納期1週間", [], ["×2", "¥1,200", "3〜5回", "1週間"], ["納期1週間"]),
        ("5個と5個 AB-1 AB-1", ["AB-1"], ["5個"], []),
        ("", [], [], []),
        (None, [], [], []),
    ],
)
def test_details(spark, text, identifiers, quantities, plans):
    assert one(spark, log_details.log_identifiers, text) == identifiers
    assert one(spark, log_details.quantities, text) == quantities
    assert one(spark, log_details.plans, text) == plans


@pytest.mark.parametrize(
    ("text", "time"),
    [
        ("9:05", "09:05"), ("23:59:59", "23:59:59"), ("24:00", None), ("9時5分", "09:05"), ("930", "09:30"), ("093015", "09:30:15"), ("0.5", "12:00"),
        ("0.999999999", "23:59:59"), ("0", "00:00"), ("12", None), ("x", None), ("", None), (None, None),
    ],
)
def test_time_of_day(spark, text, time):
    assert one(spark, time_of_day, text) == time


def test_authors_hold_on_in_time_order(spark):
    rising = "2026/4/1 田中：連絡\n2026/4/2 交換\n2026/4/3 佐藤：確認"
    falling = "2026/4/3 交換\n2026/4/2 田中：連絡\n2026/4/1 なし"
    df = logs.parse_log(spark.createDataFrame([(1, rising), (2, falling), (3, None)], "i int, t string"), "t")
    rows = {r["i"]: r for r in df.select("i", "log", logs.timeline().alias("line"), log_details.review_notes().alias("notes")).collect()}
    said = {i: [(s["author"], s["author_estimated"]) for s in rows[i]["log"]["segments"]] for i in rows}
    assert said[1] == [("田中", False), ("田中", True), ("佐藤", False)]
    assert said[2] == [("田中", True), ("田中", False), (None, False)]
    assert "2. 2026-04-02 田中（推定）: 交換" in rows[1]["line"]
    assert rows[1]["notes"] == ["2の記入者は直前の田中を引き継いだ"] and rows[3]["notes"] == []


def test_spans_and_sizes(spark):
    df = spark.createDataFrame([("a", "k1", 2), ("a", "k2", 3), ("b", "k3", 5), ("b", "k" * 70, 9), ("c", None, 1)], "g string, k string, r int")
    spans = {x["g"]: x for x in documents.record_spans(df, ["g"], ["r"], "k", "r").collect()}
    assert (spans["a"]["first_key"], spans["a"]["last_key"], spans["a"]["first_row"], spans["a"]["last_row"]) == ("k1", "k2", 2, 3)
    assert spans["b"]["first_row"] is None and spans["b"]["n_records"] == 2
    sizes = {x["g"]: x["rough_chars"] for x in checks.rough_chars(df, ["k"], ["g"]).collect()}
    assert sizes == {"a": 2 * (60 + 14), "b": 60 + 14 + 60 + 82, "c": 60}
    assert [tuple(x) for x in checks.long_values(df, "k", "r", ["g"]).collect()] == [("b", 1, [9])]
    assert checks.long_values(df.where(F.lit(False)), "k", "r", ["g"]).count() == 0


def test_file_headers(spark):
    files = spark.createDataFrame(
        [("2026-04", 1, 2, 2, 1, 2, "a_1.md"), ("2026-04", 2, 2, 1, 3, 3, "a_2.md"), ("2026-02", 1, 1, 1200, 1, 1200, "b.md"), ("日付なし", 1, 1, 4, 1, 4, "c.md"), ("", 1, 1, 5, 1, 5, "d.md")],
        "g string, part int, parts int, n_records long, first_record int, last_record int, name string",
    )
    heads = {r["name"]: r["header"].split("\n") for r in documents.file_headers(files, "点検", "g", "name").collect()}
    assert heads["a_1.md"] == [
        "# 点検 2026年4月の記録（1/2）", "", "- データ種別: 点検（1行＝1件）の記録", "- まとまり全体の対象期間: 2026-04-01〜2026-04-30",
        "- このファイルの記録: 2件（2026年4月の3件のうち1〜2件目）", "- 前のファイル: なし（これが最初）", "- 次のファイル: a_2.md",
    ]
    assert heads["a_2.md"][-2:] == ["- 前のファイル: a_1.md", "- 次のファイル: なし（これが最後）"]
    assert heads["b.md"][0] == "# 点検 2026年2月の記録" and heads["b.md"][3:] == ["- 対象期間: 2026-02-01〜2026-02-28", "- このファイルの記録: 1,200件（2026年2月の全件）"]
    assert heads["c.md"][0] == "# 点検 日付なしの記録" and heads["d.md"] == ["# 点検の記録", "", "- データ種別: 点検（1行＝1件）の記録", "- このファイルの記録: 5件（全件）"]


HEADS = [
    ("令和8年4月1日 10:00 田中：連絡", ("2026-04-01", None), ("10:00", None), None, "田中", "連絡"),
    ("R8.4.2 PM1:30 交換", ("2026-04-02", None), ("13:30", None), None, None, "交換"),
    ("26/04/03 9時半 佐藤 確認した", ("2026-04-03", None), ("09:30", None), None, "佐藤", "確認した"),
    ("2026/4/4(土) 22:00〜6:00 夜勤 巡回（田中）", ("2026-04-04", None), ("22:00", "06:00"), "夜勤", "田中", "巡回"),
    ("【2026年12月30日〜1/2】休止", ("2026-12-30", "2027-01-02"), (None, None), None, None, "休止"),
    ("2026/4/5 25:10 対応", ("2026-04-05", None), ("25:10", None), None, None, "対応"),
    ("2026-04-06T10:30:00+09:00 自動", ("2026-04-06", None), ("10:30", None), None, None, "自動"),
    ("2026/4/7 00:03 PM明け", ("2026-04-07", None), ("00:03", None), None, None, "PM明け"),
    ("２０２６／４／８　１０：００　全角", ("2026-04-08", None), ("10:00", None), None, None, "全角"),
    ("2026/4/8 99:99 停止", ("2026-04-08", None), (None, None), None, None, "99:99 停止"),
    ("1.5mm 交換", (None, None), (None, None), None, None, "1.5mm 交換"),
    ("納期4/8", (None, None), (None, None), None, None, "納期4/8"),
    ("2026/2/30 ない日", (None, None), (None, None), None, None, "2026/2/30 ない日"),
    ("10:30 だけ", (None, None), (None, None), None, None, "10:30 だけ"),
    ("2026/4/9 停止（未完）", ("2026-04-09", None), (None, None), None, None, "停止（未完）"),
    ("2026/9/25 22:00〜9/26 6:00 夜間停止", ("2026-09-25", "2026-09-26"), ("22:00", "06:00"), None, None, "夜間停止"),
    ("2026/12/31 23:00〜1/1 1:00 監視", ("2026-12-31", "2027-01-01"), ("23:00", "01:00"), None, None, "監視"),
    ("1. 2026.4.10（金曜日） 8時5分30秒 始動", ("2026-04-10", None), ("08:05", None), None, None, "始動"),
    ("2026/4/11 3:20 p.m. 停止", ("2026-04-11", None), ("15:20", None), None, None, "停止"),
    ("2026/4/11 12:05 AM 停止", ("2026-04-11", None), ("00:05", None), None, None, "停止"),
    ("2026/4/12 午後3時〜5時 清掃", ("2026-04-12", None), ("15:00", "05:00"), None, None, "清掃"),
    ("2026/4/13 3時間 停止", ("2026-04-13", None), (None, None), None, None, "3時間 停止"),
    ("2026/4/14 午前中 待機", ("2026-04-14", None), (None, None), "午前中", None, "待機"),
    ("平成30年4月15日〜4月16日 停止", ("2018-04-15", "2018-04-16"), (None, None), None, None, "停止"),
    ("2026.4.1.2 版", (None, None), (None, None), None, None, "2026.4.1.2 版"),
    ("製造課 田中 確認", (None, None), (None, None), None, "田中", "確認"),
    ("2026/4/16 製造課: 連絡", ("2026-04-16", None), (None, None), None, "製造課", "連絡"),
    ("2026/4/17 製造課長に連絡", ("2026-04-17", None), (None, None), None, None, "製造課長に連絡"),
    ("2026/4/18田中弁を交換", ("2026-04-18", None), (None, None), None, "田中", "弁を交換"),
    ("2026/4/19 田中→佐藤 引継ぎ", ("2026-04-19", None), (None, None), None, "田中", "引継ぎ"),
    ("2026/4/20 調整した（2026/4/21 佐藤）", ("2026-04-20", None), (None, None), None, "佐藤", "調整した"),
    ("2026/4/22 確認（済）佐藤", ("2026-04-22", None), (None, None), None, "佐藤", "確認（済）"),
    ("2026/4/23 ｽｽﾞｷ 点検", ("2026-04-23", None), (None, None), None, "スズキ", "点検"),
    ("2026/4/24 スズキ製の弁", ("2026-04-24", None), (None, None), None, None, "スズキ製の弁"),
    ("2026/4/25 伊藤 確認", ("2026-04-25", None), (None, None), None, "伊藤", "確認"),
]


def test_heads_and_authors(spark):
    """Registered people, a loose form from a column, a group, and a surname that two people share."""
    column = spark.createDataFrame([("スズキ、不明",), (None,)], "who string")
    index = people.people_index(spark, column, [{"name": "田中"}, {"name": "佐藤"}, {"name": "伊藤 一"}, {"name": "伊藤 二"}], ["製造課"])
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(HEADS)], "i int, t string")
    got = {r["i"]: r["log"]["segments"][0] for r in logs.parse_log(df, "t", people=index).collect()}
    for i, (text, days, times, shift, author, body) in enumerate(HEADS):
        s = got[i]
        assert ((s["date"], s["date_to"]), (s["time"], s["time_to"]), s["shift"], s["author"], s["body"]) == (days, times, shift, author, body), text
    assert got[len(HEADS) - 1]["author_people"] == 2


def test_cutting_is_linear_and_exact(spark):
    text = "前書き\n" + "\n".join(f"2026/4/{i % 28 + 1} 10:00 作業{i}\n続き" for i in range(8000))
    df = spark.createDataFrame([(text,), ("\n",), ("２０２６／４／１ a\nb",)], "t string")
    got = [r["p"] for r in df.select(logs.split_pieces("t").alias("p")).collect()]
    assert len(got[0]) == 8001 and "\n".join(got[0]) == text and got[1] == ["\n"] and got[2] == ["２０２６／４／１ a\nb"]


def test_people_and_base_dates(spark):
    df = spark.createDataFrame([("田中 一郎、佐藤さん",), ("不明",), (None,), ("佐藤",)], "who string")
    assert {r["name"] for r in logs.people_names(df, "who").collect()} == {"田中 一郎", "田中", "佐藤"}
    values = spark.createDataFrame([({"at": "2026/4/1 10:00", "end": "2026-04-05"},), ({"at": "4/1", "end": "2026-04-05"},), ({},)], "v map<string,string>")
    assert [r["d"] for r in values.select(logs.base_date("v", ["at", "end"]).alias("d")).collect()] == ["2026-04-01", "2026-04-05", None]


def test_units_come_from_one_pattern(spark):
    """Every unit is found alone, and none that ends in a letter where letters go on."""
    rows = spark.createDataFrame([(u, f"5{u}", f"5{u}q") for u in log_details.UNITS], "u string, alone string, on string")
    for r in rows.select("u", log_details._unit_of(F.substring("alone", 2, 9)).alias("a"), log_details._unit_of(F.substring("on", 2, 9)).alias("b")).collect():
        assert r["a"] == r["u"]
        assert r["b"] == (None if r["u"][-1].isascii() and r["u"][-1].isalpha() else r["u"])
    assert log_details._UNIT.startswith("^(")
