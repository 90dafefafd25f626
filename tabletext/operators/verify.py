"""Verification of language-model answers about a log, as expressions: what fails is listed, nothing is repaired.

An answer is JSON with ``entries`` (segments, type, text, quote). Fatal: it is no JSON, or segments are missing, doubled or
not adjacent. Errors and warnings are given per entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions.text import identifiers, numbers_in, one_line
from tabletext.operators.enrich import json_of

ANSWER = "entries array<struct<segments: array<int>, type: string, text: string, quote: string>>, summary string"
MAX_TEXT = 80
# Words that turn a statement round if they are put in or left out.
FLIP_WORDS = ["予定", "待ち", "完了", "未", "中止", "依頼", "検討", "不明", "正常", "異常", "再発", "なし"]
DATE = "[12][0-9]{3}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}|[0-9]{1,2}月[0-9]{1,2}日|[0-9]{1,2}/[0-9]{1,2}"


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "(?U)[\\s、。,.・「」『』()（）]+", "")


def verify(df: DataFrame, answer: str, segments: str, types: list[str], names: list[str] | None = None, out: str = "issues") -> DataFrame:
    """Adds an array of (level, code, entry) to rows with an answer and its source segments (array of texts)."""
    df = df.withColumn("_answer", F.from_json(json_of(answer), ANSWER)).withColumn("_n", F.size(segments))
    source = F.col(segments)
    used = F.sort_array(F.flatten(F.transform(F.col("_answer.entries"), lambda e: F.coalesce(e["segments"], F.array().cast("array<int>")))))
    whole = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def issue(level: str, code: str, i: Column, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), i.cast("int").alias("entry")))

    def entry(e: Column, i: Column) -> Column:
        own = F.filter(F.coalesce(e["segments"], F.array().cast("array<int>")), lambda s: (s >= 1) & (s <= F.col("_n")))
        evidence = F.array_join(F.transform(own, lambda s: F.get(source, s - 1)), "\n")
        text = F.coalesce(e["text"], F.lit(""))
        low, high = F.array_min(e["segments"]), F.array_max(e["segments"])
        named = F.lit(False)
        for n in names or []:
            named |= F.contains(text, F.lit(n))
        added, dropped = F.lit(False), F.lit(False)
        for w in FLIP_WORDS:
            added |= F.contains(text, F.lit(w)) & ~F.contains(evidence, F.lit(w))
            dropped |= F.contains(evidence, F.lit(w)) & ~F.contains(text, F.lit(w))
        tests = [
            issue("fatal", "not_adjacent", i, (F.size(e["segments"]) > 0) & (high - low + 1 != F.size(e["segments"]))),
            issue("fatal", "no_segments", i, F.coalesce(F.size(e["segments"]), F.lit(0)) <= 0),
            issue("error", "type", i, ~F.coalesce(e["type"], F.lit("")).isin(types)),
            issue("error", "too_long", i, F.length(text) > MAX_TEXT),
            issue("error", "identifier", i, F.size(F.array_except(identifiers(text), identifiers(evidence))) > 0),
            issue("error", "number", i, F.size(F.array_except(numbers_in(text), numbers_in(evidence))) > 0),
            issue("error", "date", i, F.regexp_like(text, F.lit(DATE))),
            issue("error", "name", i, named),
            issue("error", "quote", i, (F.coalesce(e["quote"], F.lit("")) != "") & ~F.contains(_norm(evidence), _norm(e["quote"]))),
            issue("error", "flip_added", i, added),
            issue("warning", "flip_dropped", i, dropped),
        ]
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    per_entry = F.flatten(F.transform("_answer.entries", entry))
    said = F.array_join(F.transform("_answer.entries", lambda e: F.coalesce(e["text"], F.lit(""))), "\n")
    lost = F.size(F.array_except(identifiers(F.array_join(source, "\n")), identifiers(said))) > 0
    nothing = F.lit(0)
    overall = F.filter(
        F.array(
            issue("fatal", "json", nothing, F.col("_answer.entries").isNull()),
            issue("fatal", "coverage", nothing, F.col("_answer.entries").isNotNull() & (used != whole)),
            issue("warning", "identifiers_missing", nothing, (F.col("_n") >= 2) & F.col("_answer.entries").isNotNull() & lost),
        ),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<struct<level: string, code: string, entry: int>>")
    return df.withColumn(out, F.concat(overall, F.coalesce(per_entry, none))).drop("_answer", "_n")


def verdict(issues: str = "issues") -> Column:
    """``error`` for fatal issues, ``flagged`` for errors, else ``ok``."""
    has = lambda level: F.exists(issues, lambda x: x["level"] == level)
    return F.when(has("fatal"), "error").when(has("error"), "flagged").otherwise("ok")


def segment_types(answer: str) -> Column:
    """Map from segment number to the type of the entry that holds it."""
    entries = F.from_json(json_of(answer), ANSWER)["entries"]
    pairs = F.flatten(F.transform(entries, lambda e: F.transform(e["segments"], lambda s: F.struct(s.alias("key"), e["type"].alias("value")))))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))


def custom_result(answer: str, choices: list[str] | None = None, limit: int = 200, fallback: str | None = None) -> Column:
    """A text or choice that a custom stage asked for; what is not allowed becomes the fallback."""
    text = one_line(F.regexp_replace(F.col(answer), "(?s)<think>.*?</think>", ""))
    good = text.isin(choices) if choices else (F.length(text).between(1, limit))
    return F.when(good, text).otherwise(F.lit(fallback))


def estimate(rows: int, p75_tokens: float, seconds: float = 8.0, concurrency: int = 4, tokens_a_minute: int | None = None, attempts: float = 1.0) -> dict:
    """Tokens and minutes of a run: the slower of what concurrency and the token limit allow."""
    calls = rows * attempts
    tokens = calls * p75_tokens
    minutes = [calls * seconds / 60 / concurrency] + ([tokens / tokens_a_minute] if tokens_a_minute else [])
    return {"calls": calls, "tokens": tokens, "minutes": max(minutes)}
