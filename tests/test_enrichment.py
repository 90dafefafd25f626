"""Two rounds of requests against an injected client that writes down its calls."""

import json
import os
import uuid

from pyspark.sql import functions as F

from tabletext.operators import logs
from tabletext.plans import enrichment

TYPES = ["点検", "計画"]


def client_of(folder):
    def client(prompt):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        k = int(prompt.split("\n")[0])
        repair = "誤り" in prompt
        if k == 4:
            raise TimeoutError("late")
        if k == 1 and not repair or k == 2:
            return "no answer"
        text = "部品9個を点検" if k == 3 and repair else "部品を点検"
        kind = "別" if k == 3 or k == 5 and not repair else "点検"
        return json.dumps({"entries": [{"segments": [1], "type": kind, "text": text, "quote": ""}]}, ensure_ascii=False)

    return client


def calls(folder):
    return sorted(open(os.path.join(folder, f)).read().split("\n")[0] for f in os.listdir(folder))


def test_two_rounds_and_rerun(spark, tmp_path):
    folder, cache = tmp_path / "calls", str(tmp_path / "cache")
    folder.mkdir()
    rows = [(f"r{i}", str(k), ["部品 3 個を点検"]) for i, k in enumerate([0, 0, 1, 2, 3, 4, 5, 5])]
    works = spark.createDataFrame(rows, "key string, prompt string, segments array<string>")
    run = lambda: {r["key"]: (r["status"], r["attempts"], r["repaired"]) for r in enrichment.execute(works, cache, client_of(str(folder)), TYPES).collect()}
    want = {
        "r0": ("ok", 1, False), "r1": ("ok", 1, False), "r2": ("ok", 2, True), "r3": ("error", 2, True), "r4": ("flagged", 2, True), "r5": ("error", 1, False),
        "r6": ("ok", 2, True), "r7": ("ok", 2, True),
    }
    assert run() == want
    # once a distinct request, once more where it failed; the call that fails is tried three times and not repaired
    first = calls(folder)
    assert first == sorted(["0", "1", "1", "2", "2", "3", "3", "4", "4", "4", "5", "5"])
    assert run() == want
    assert calls(folder) == sorted([*first, "4", "4", "4"])  # only what has no answer is asked again
    totals = {r["status"]: (r["n_rows"], r["n_repaired"]) for r in enrichment.run_totals(enrichment.execute(works, cache, client_of(str(folder)), TYPES)).collect()}
    assert totals == {"ok": (5, 3), "error": (2, 1), "flagged": (1, 1)}
    assert enrichment.execute(works.where("key = ''"), cache, client_of(str(folder)), TYPES).count() == 0


def test_settings_are_part_of_the_key(spark, tmp_path):
    folder, cache = tmp_path / "calls", str(tmp_path / "cache")
    folder.mkdir()
    works = spark.createDataFrame([("a", "0", ["x"])], "key string, prompt string, segments array<string>")
    for settings in ("m1", "m2", "m1"):
        enrichment.execute(works, cache, client_of(str(folder)), TYPES, settings=settings).collect()
    assert calls(folder) == ["0", "0"]


def test_preparation(spark):
    log = logs.parse_log(spark.createDataFrame([("2026/4/1 田中：点検",), ("2026/4/1 佐藤：点検",), ("2026/4/2 田中：点検",)], "t string"), "t")
    hashes = [r["h"] for r in log.select(enrichment.segments_hash("log").alias("h")).collect()]
    assert hashes[0] == hashes[1] != hashes[2]  # who wrote it does not count
    one = {"url": "u", "model": "m", "params": {"b": 1, "a": 2}, "key": "secret"}
    assert enrichment.settings_fingerprint(one) == enrichment.settings_fingerprint({**one, "key": "x", "params": {"a": 2, "b": 1}}) != enrichment.settings_fingerprint(one, "json")
    told = log.select(enrichment.messages("rules", [("q", "a"), ("", "x")], F.col("t")).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in told] == [("system", "rules"), ("user", "q"), ("assistant", "a"), ("user", "2026/4/1 田中：点検")]
    assert enrichment.answer_schema(TYPES)["properties"]["entries"]["items"]["properties"]["type"]["enum"] == TYPES
    states = spark.createDataFrame([(None, None), ("ok", False), ("ok", True), ("error", False), ("flagged", False), ("outdated", False)], "s string, o boolean")
    asked = {scope: [r["x"] for r in states.select(enrichment.in_scope(scope, F.col("s"), F.col("o")).alias("x")).collect()] for scope in enrichment.SCOPES}
    assert asked == {
        "pending": [True, False, True, True, False, True], "all": [True] * 6, "errors": [False, False, False, True, False, False],
        "flagged": [False, False, False, False, True, False], "changed": [False, False, True, False, False, True],
    }
    assert enrichment.usable(states.withColumnRenamed("s", "status")).count() == 3
    issues = spark.createDataFrame([("error", 2), ("warning", 3), ("error", 1)], "level string, n long")
    assert {(r["level"], r["n"], r["blocks"]) for r in enrichment.level_counts(issues).collect()} == {("error", 3, True), ("warning", 3, False)}
