"""Points of an incident that an answer claims: checked against the segments they are said to come from, and written as lines.

Each point names its segments (``src``, numbers from 1). A point is dropped if it names none or one that is not there, if its
numbers or identifiers, its quoted words or counts are not in them, or if its choice is not allowed; what was dropped and why is
listed. Edge cases: an answer that is no JSON, or has no incident, has no points and
no issues; blank points are no points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions.text import identifiers, let, numbers_in, one_line
from tabletext.operators.enrich import json_of

# Allowed choices and the labels of lines.
CERTAINTIES = ["確定", "推定", "可能性"]
FINAL_STATES = ["復旧", "仮復旧", "監視中", "未復旧", "不明"]
LABELS = {"root_cause": "原因", "temporary_actions": "暫定処置", "permanent_actions": "恒久処置", "parts": "使用部品", "recurrence": "再発", "final_state": "最終状態"}
ANSWER = (
    "incident struct<root_cause:struct<v:string,q:string,certainty:string,src:array<int>>,temporary_actions:array<struct<v:string,src:array<int>>>,"
    "permanent_actions:array<struct<v:string,src:array<int>>>,parts:array<struct<name:string,model:string,qty:string,src:array<int>>>,"
    "recurrence:struct<v:string,count:string,src:array<int>>,final_state:struct<v:string,src:array<int>>>"
)


def _points(incident: Column) -> Column:
    """All claimed points as (kind, number, v, q, extra, src): what is said, what is quoted, and what is said about it."""
    none = F.lit(None).cast("string")

    def point(kind: str, i: Column, v: Column, q: Column, extra: Column, src: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("number"), one_line(v).alias("v"), one_line(q).alias("q"), one_line(extra).alias("extra"), src.alias("src"))

    one = F.lit(1)
    cause, again, last = incident["root_cause"], incident["recurrence"], incident["final_state"]
    single = [
        point("root_cause", one, cause["v"], cause["q"], cause["certainty"], cause["src"]),
        point("recurrence", one, again["v"], again["count"], again["count"], again["src"]), point("final_state", one, last["v"], none, none, last["src"]),
    ]

    def actions(kind: str) -> Column:
        return F.transform(incident[kind], lambda a, i: point(kind, i + 1, a["v"], none, none, a["src"]))

    parts = F.transform(incident["parts"], lambda p, i: point("parts", i + 1, F.concat_ws(" ", p["name"], p["model"]), p["qty"], p["qty"], p["src"]))
    nothing = F.slice(F.array(single[0]), 1, 0)
    lists = [F.coalesce(x, nothing) for x in (actions("temporary_actions"), actions("permanent_actions"), parts)]
    return F.filter(F.flatten(F.array(F.array(*single), *lists)), lambda p: F.coalesce(p["v"], F.lit("")) != "")


def check_incident(df: DataFrame, answer: str, segments: str, out: str = "points") -> DataFrame:
    """Adds the points that hold (kind, number, v, q, extra, src), and ``{out}_issues`` (kind, number, code) of those that do not."""
    source = F.col(segments)
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "(?U)[\\s、。,.・]+", "")

    def judged(p: Column) -> Column:
        own = F.coalesce(p["src"], F.array().cast("array<int>"))
        evidence = F.array_join(F.transform(F.filter(own, lambda i: (i >= 1) & (i <= F.size(source))), lambda i: F.get(source, i - 1)), "\n")
        return let(evidence, lambda e: F.struct(p.alias("p"), F.array_compact(F.array(*codes(p, own, e))).alias("codes")))

    def codes(p: Column, own: Column, evidence: Column) -> list[Column]:
        when = lambda test, code: F.when(test, F.lit(code))
        return [
            when(F.size(own) == 0, "no_source"), when(F.exists(own, lambda i: (i < 1) | (i > F.size(source))), "bad_source"),
            when((p["kind"] != "final_state") & (F.size(F.array_except(numbers_in(p["v"]), numbers_in(evidence))) > 0), "number"),
            when((p["kind"] != "final_state") & (F.size(F.array_except(identifiers(p["v"]), identifiers(evidence))) > 0), "identifier"),
            when((F.coalesce(p["q"], F.lit("")) != "") & ~F.contains(plain(evidence), plain(p["q"])), "quote"),
            when((p["kind"] == "parts") & ~F.contains(plain(evidence), plain(p["v"])), "part"),
            when((p["kind"] == "root_cause") & ~F.coalesce(p["extra"], F.lit("")).isin(CERTAINTIES), "certainty"),
            when((p["kind"] == "final_state") & ~p["v"].isin(FINAL_STATES), "state"),
        ]

    marked = df.withColumn("inc_read", F.from_json(json_of(answer), ANSWER)["incident"])
    marked = marked.withColumn("inc_all", F.when(F.col("inc_read").isNotNull(), F.transform(_points(F.col("inc_read")), judged)))
    kept = F.transform(F.filter("inc_all", lambda x: F.size(x["codes"]) == 0), lambda x: x["p"])
    wrong = F.flatten(F.transform("inc_all", lambda x: F.transform(x["codes"], lambda c: F.struct(x["p"]["kind"].alias("kind"), x["p"]["number"].alias("number"), c.alias("code")))))
    return marked.withColumn(out, kept).withColumn(f"{out}_issues", wrong).drop("inc_read", "inc_all")


def point_lines(points: Column | str) -> Column:
    """``label: points`` of each kind that has any, in the order of the labels; certainty, quantity and count stand behind."""
    p = F.col(points) if isinstance(points, str) else points

    def line(kind: str, label: str) -> Column:
        def said(x: Column) -> Column:
            more = F.coalesce(x["extra"], F.lit(""))
            behind = F.concat(F.lit(" "), more) if kind == "parts" else F.concat(F.lit("（"), more, F.lit("）"))
            return F.concat(x["v"], F.when(more != "", behind).otherwise(""))

        own = F.filter(p, lambda x: x["kind"] == kind)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.transform(own, said), "、")))

    return F.array_compact(F.array(*[line(k, v) for k, v in LABELS.items()]))
