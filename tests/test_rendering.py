"""Records in the order of a spec."""


from tabletext.operators import people
from tabletext.operators.documents import TokenCounts
from tabletext.plans import export, rendering
from tabletext.plans.spec import ColumnSpec, TableSpec

SPEC = TableSpec("点検", [
    ColumnSpec("管理No", "no", "code", "key"), ColumnSpec("発生日", "occurred_date", "date", "date"), ColumnSpec("時刻", "occurred_time", "time"),
    ColumnSpec("設備番号", "eq", "code", "entity"), ColumnSpec("設備名", "eq_name", "string", "entity_label"), ColumnSpec("停止時間(h)", "stop", "number", "measure", "h"),
    ColumnSpec("現象", "symptom", "text", "text"), ColumnSpec("経過", "log", "text", "log"), ColumnSpec("備考", "memo", output="omit"),
])
SCHEMA = "file string, sheet string, record_row int, record_key string, date_value string, values map<string,string>"
ROWS = [
    ("/d/a.xlsx", "一覧", 5, "K-1", "2026-04-01", {"no": "K-1", "occurred_date": "2026-04-01", "occurred_time": "10:30", "eq": "A-302", "eq_name": "2番", "stop": "1.5", "symptom": "2026/4/1 異音がした\n続く", "log": "2026/4/2 田中 交換\n2026/4/1 連絡", "memo": "x"}),
    ("/d/a.xlsx", "一覧", 6, "K-2", None, {"no": "K-2", "eq": "ポンプ(P-9)", "stop": "約3", "symptom": "長い。" * 500, "log": "なし"}),
    ("/d/b.csv", "", 7, "行7", "2026-04", {"stop": "0", "occurred_date": "2026-04"}),
    ("/d/b.csv", "", 8, "行8", None, {}),
    ("/d/b.csv", "", 9, "行9", "2026-04", {"stop": "0", "occurred_date": "2026-04"}),
]


def test_spec_order(spark):
    index = people.people_index(spark, registered=[{"name": "田中"}])
    got = {r["record_key"]: r for r in rendering.rendered(spark.createDataFrame(ROWS, SCHEMA), SPEC, index).withColumn("texts", rendering.record_parts.part_texts("lines")).collect()}
    assert got["K-1"]["texts"] == ["\n".join([
        "## 【K-1】2番（A-302）異音がした｜2026-04-01", "- 管理No: K-1", "- 発生日: 2026-04-01 10:30（2026年4月）", "- 設備: 2番（A-302）", "- 停止時間: 1.5時間",
        "- 現象:", "  2026/4/1 異音がした", "  続く", "- 対応の時系列:", "  1. 2026-04-01: 連絡", "  2. 2026-04-02 田中: 交換", "- 出典: a.xlsx（管理No K-1・シート「一覧」5行目）",
    ])]
    long = got["K-2"]["texts"]
    n = len(long)
    assert n > 3 and long[1].startswith(f"## 【K-2】ポンプ(P-9) {'長い。' * 13}") and f"（続き2/{n}）\n- 管理No: K-2\n- 設備番号: ポンプ(P-9)\n" in long[1]
    assert all(TokenCounts(p)(0, len(p)) <= 400 for p in long)
    assert got["行7"]["texts"] == ["## 0｜2026-04（7行目）\n- 発生日: 2026-04（2026年4月）\n- 停止時間: 0時間\n- 出典: b.csv（7行目）"]
    assert got["行8"]["texts"] == ["## 8行目の記録\n- 出典: b.csv（8行目）"]


def test_entity_in_one_column(spark):
    spec = TableSpec("x", [ColumnSpec("設備", "eq", "string", "entity"), ColumnSpec("内容", "t", "text", "text")])
    df = spark.createDataFrame([("a.csv", "", 1, "1", None, {"eq": "送風機(AB-12)", "t": "a"}), ("a.csv", "", 2, "2", None, {"eq": "送風機", "t": ""})], SCHEMA)
    got = [r["block"] for r in rendering.spec_blocks(df, spec).orderBy("record_row").collect()]
    assert got == ["## 送風機（AB-12）a\n- 設備: 送風機（AB-12）\n- 内容: a\n- 出典: a.csv（1行目）", "## 送風機\n- 設備: 送風機\n- 出典: a.csv（2行目）"]


def test_files_with_spec(spark):
    files = export.render(spark.createDataFrame(ROWS, SCHEMA), table="点検", spec=SPEC).orderBy("file_name").collect()
    assert [f["file_name"] for f in files] == ["2026-04.md", "日付なし.md"] and [f["n_records"] for f in files] == [3, 2]
    assert files[0]["text"].startswith("# 点検 2026年4月の記録") and "（続き2/" in files[1]["text"]
