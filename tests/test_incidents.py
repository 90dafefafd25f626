"""Points of incidents: what the segments carry is kept, the rest is listed."""

import json

from tabletext.operators import incidents
from tabletext.plans import rendering
from tabletext.plans.spec import ColumnSpec, TableSpec

SEGMENTS = ["2026/4/1 異音。ベアリング摩耗と推定", "4/2 ベアリング 6203 を2個交換し復旧。3回目の再発"]


def answer(**incident):
    return "```json\n" + json.dumps({"incident": incident}, ensure_ascii=False) + "\n```"


def test_points(spark):
    good = answer(
        root_cause={"v": "ベアリング摩耗", "q": "ベアリング摩耗", "certainty": "推定", "src": [1]}, temporary_actions=[], permanent_actions=[{"v": "ベアリングを交換", "src": [2]}, {"v": " ", "src": [2]}],
        parts=[{"name": "ベアリング", "model": "6203", "qty": "2個", "src": [2]}], recurrence={"v": "あり", "count": "3回目", "src": [2]}, final_state={"v": "復旧", "src": [2]},
    )
    bad = answer(
        root_cause={"v": "E-99 の故障", "q": "故障", "certainty": "推定", "src": [1]}, permanent_actions=[{"v": "9個交換", "src": [2]}, {"v": "清掃", "src": []}],
        parts=[{"name": "ポンプ", "src": [2]}], recurrence={"v": "あり", "count": "5回", "src": [7]}, final_state={"v": "完了", "src": [2]},
    )
    rows = [(1, good, SEGMENTS), (2, bad, SEGMENTS), (3, "no json", SEGMENTS), (4, None, None), (5, "{}", []), (6, answer(), SEGMENTS)]
    done = incidents.check_incident(spark.createDataFrame(rows, "i int, a string, s array<string>"), "a", "s")
    got = {r["i"]: r for r in done.withColumn("lines", incidents.point_lines("points")).collect()}
    assert got[1]["lines"] == ["原因: ベアリング摩耗（推定）", "恒久処置: ベアリングを交換", "使用部品: ベアリング 6203 2個", "再発: あり（3回目）", "最終状態: 復旧"] and got[1]["points_issues"] == []
    assert got[2]["lines"] == []
    assert {(x["kind"], x["number"], x["code"]) for x in got[2]["points_issues"]} == {
        ("root_cause", 1, "number"), ("root_cause", 1, "identifier"), ("root_cause", 1, "quote"), ("permanent_actions", 1, "number"), ("permanent_actions", 2, "no_source"),
        ("parts", 1, "part"), ("recurrence", 1, "bad_source"), ("recurrence", 1, "quote"), ("final_state", 1, "state"),
    }
    assert all(not (got[i]["points"] or []) and not (got[i]["points_issues"] or []) for i in (3, 4, 5, 6))


def test_points_in_records(spark):
    spec = TableSpec("x", [ColumnSpec("No", "no", "code", "key")])
    text = answer(final_state={"v": "復旧", "src": [2]})
    df = spark.createDataFrame([("a.csv", "", 1, "1", None, {"no": "1"}, text, SEGMENTS)], "file string, sheet string, record_row int, record_key string, date_value string, values map<string,string>, a string, s array<string>")
    done = rendering.rendered(incidents.check_incident(df, "a", "s"), spec, points="points")
    assert done.first()["body"] == ["- No: 1", "- 対応の要点（AI抽出）:", "  最終状態: 復旧", "- 出典: a.csv（No 1・1行目）"]
