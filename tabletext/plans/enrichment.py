"""Language-model enrichment in two rounds: what the cache lacks is asked, answers are checked, what fails is asked once more.

The cache is a table of answers by request key in a shared folder; each round appends its answers before they are used, so
a run that is broken off or repeated asks only for what is not there. Equal requests are asked once, whatever rows share them.

Edge cases: a null prompt is asked as an empty text; a call that fails leaves its error in the row and nothing in the cache; an
empty table of works calls nothing and gives no rows; repeated rows share one answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.operators import enrich, verify
from tabletext.session import stored

CACHE = "cache_key string, answer string"
#: Stands before the list of what was wrong, in a request for repair.
REPAIR = "\n\n前の回答に次の誤りがあります。直した全文を返してください:\n"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Answers by key; an answer that was stored twice by a repeated run counts once."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # nothing was written yet
        found = spark.createDataFrame([], CACHE)
    return found.groupBy("cache_key").agg(F.min("answer").alias("answer"))


def ask(requests: DataFrame, cache_path: str, client: Callable[[str], str]) -> DataFrame:
    """(cache_key, answer, error) of requests (cache_key, prompt): from the cache, else from the client, whose answers go into it."""
    spark = requests.sparkSession
    single = requests.groupBy("cache_key").agg(F.min("prompt").alias("prompt"))
    open_ = enrich.missing(single, read_cache(spark, cache_path), "cache_key")
    # each key's call in one task; written at once, since a second evaluation would call again
    called = stored(enrich.call(open_.repartition("cache_key"), client))
    called.where("answer IS NOT NULL").select("cache_key", "answer").write.mode("append").parquet(cache_path)
    failed = called.where("answer IS NULL").select("cache_key", F.lit(None).cast("string").alias("answer"), "error")
    known = enrich.fan_out(single.select("cache_key"), read_cache(spark, cache_path), "cache_key").withColumn("error", F.lit(None).cast("string"))
    return known.unionByName(failed)


def _problems(issues: str = "issues") -> Column:
    """Fatal issues and errors as a text; empty if there are none."""
    wrong = F.filter(issues, lambda x: x["level"].isin("fatal", "error"))
    return F.array_join(F.array_sort(F.transform(wrong, lambda x: F.concat(F.lit("- "), x["code"], F.lit(" ("), x["entry"].cast("string"), F.lit(")")))), "\n")


def _checked(works: DataFrame, answers: DataFrame, types: list[str], names: list[str] | None) -> DataFrame:
    joined = works.join(answers, "cache_key")
    done = verify.verify(joined, "answer", "segments", types, names)
    status = F.when(F.col("answer").isNull(), "error").otherwise(verify.verdict())
    return done.withColumn("status", status).withColumn("problems", F.when(F.col("answer").isNotNull(), _problems()).otherwise(""))


def execute(works: DataFrame, cache_path: str, client: Callable[[str], str], types: list[str], names: list[str] | None = None, settings: str = "") -> DataFrame:
    """(key, status, answer, issues, error, attempts, repaired) of works (key, prompt, segments).

    ``settings`` (model, schema, parameters as canonical JSON) is part of a request's key. A repaired answer counts unless it
    is broken where the first one is not.
    """
    plain = works.select("key", F.coalesce("prompt", F.lit("")).alias("prompt"), "segments").withColumn("settings", F.lit(settings))
    plain = stored(plain.withColumn("cache_key", enrich.cache_key("settings", "prompt")))
    first = stored(_checked(plain, ask(plain.select("cache_key", "prompt"), cache_path, client), types, names))
    again = first.where("problems <> ''").select("key", F.concat("prompt", F.lit(REPAIR), "problems").alias("prompt"), "segments", "settings", F.col("cache_key").alias("first_key"))
    again = stored(again.withColumn("cache_key", enrich.cache_key("settings", "prompt")))
    second = _checked(again, ask(again.select("cache_key", "prompt"), cache_path, client), types, names)
    second = stored(second.groupBy("first_key", F.to_json("segments").alias("cells")).agg(
        F.min(F.struct("status", "answer", "issues", "error")).alias("repair")))
    second = second.withColumnsRenamed({"first_key": "repair_key", "cells": "repair_cells"})
    both = first.join(second, (F.col("cache_key") == F.col("repair_key")) & F.to_json("segments").eqNullSafe(F.col("repair_cells")), "left")
    took = F.col("repair").isNotNull() & F.col("repair.answer").isNotNull() & ~((F.col("repair.status") == "error") & (F.col("status") != "error"))
    pick = lambda c: F.when(took, F.col(f"repair.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("key", pick("status"), pick("answer"), pick("issues"), pick("error"), F.when(F.col("repair").isNull(), 1).otherwise(2).alias("attempts"), took.alias("repaired"))


def run_totals(done: DataFrame) -> DataFrame:
    """Rows a status, and how many of them needed a second answer."""
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("attempts") == 2).alias("n_repaired"))


# --- what is asked, and what it will cost

#: Output tokens: at least, for each segment, for each token of the text, at most.
OUTPUT_TOKENS = {"base": 400, "per_segment": 40, "per_input_token": 2, "max": 2000}
SCOPES = ["pending", "all", "errors", "flagged", "changed"]


def output_tokens(n_segments: Column, text_tokens: Column, limits: dict[str, int] | None = None) -> Column:
    """Tokens that an answer may have: what segments need or what the text needs, the larger one, within the limit."""
    n = OUTPUT_TOKENS | (limits or {})
    return F.least(F.lit(n["max"]), F.lit(n["base"]) + F.greatest(n_segments * n["per_segment"], text_tokens * n["per_input_token"])).cast("bigint")


def segments_hash(log: Column | str) -> Column:
    """SHA-256 of how a log was cut: kind, and number, text, days, times and shift of each segment; authors are not sent and do not count."""
    l = F.col(log) if isinstance(log, str) else log  # noqa: E741
    kept = F.transform(l["segments"], lambda s: F.struct(*[s[c] for c in ("id", "body", "date", "date_to", "time", "time_to", "shift", "how")]))
    return F.sha2(F.to_json(F.struct(l["kind"].alias("kind"), kept.alias("segments"))), 256)


def settings_fingerprint(settings: dict, mode: str | None = None) -> str:
    """Sixteen hex digits of address, model and parameters; keys to the address are no part of it."""
    told = {k: settings.get(k) or ("" if k != "params" else {}) for k in ("url", "model", "params")} | ({"mode": mode} if mode else {})
    return hashlib.sha256(enrich.stable_json(told).encode()).hexdigest()[:16]


def messages(system: str, examples: list[tuple[str, str]], user: Column) -> Column:
    """The messages of a request: rules, pairs of question and answer, the row's own text."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), (text if isinstance(text, Column) else F.lit(text)).alias("content"))
    shots = [m for question, answer in examples if question and answer for m in (message("user", question), message("assistant", answer))]
    return F.array(message("system", system), *shots, message("user", user))


def answer_schema(types: list[str]) -> dict:
    """JSON schema of an answer as ``verify.verify`` reads it."""
    entry = {"segments": {"type": "array", "items": {"type": "integer"}}, "type": {"type": "string", "enum": types}, "text": {"type": "string", "maxLength": verify.MAX_TEXT}, "quote": {"type": "string"}}
    entries = {"type": "array", "items": {"type": "object", "properties": entry, "required": ["segments", "type", "text"], "additionalProperties": False}}
    return {"type": "object", "properties": {"entries": entries, "summary": {"type": "string"}}, "required": ["entries"]}


def in_scope(scope: str, status: Column, outdated: Column) -> Column:
    """Whether a row is asked in a run of some scope, given the status of its last result (null: none) and whether it is out of date."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    old = F.coalesce(outdated, F.lit(False))
    rules = {
        "all": F.lit(True), "errors": status.eqNullSafe("error"), "flagged": status.eqNullSafe("flagged"), "changed": old | status.eqNullSafe("outdated"),
        "pending": status.isNull() | status.isin("pending", "error", "outdated") | old,
    }
    return rules[scope]


def usable(done: DataFrame) -> DataFrame:
    """Results that are rendered: those that passed and those with marks; the others fall back on the rules."""
    return done.where(F.col("status").isin("ok", "flagged"))


def estimate_import(works: DataFrame, cache: DataFrame, scope: str = "pending", seconds: float = 8.0, concurrency: int = 4) -> DataFrame:
    """One row of what a run over works (cache_key, route, status, outdated, tokens_in, max_tokens) will call.

    Rows by route, rows that are done already, rows that share a request, requests in the cache, calls, tokens and minutes.
    """
    marked = works.withColumn("asked", in_scope(scope, F.col("status"), F.col("outdated")))
    ai = F.col("asked") & (F.col("route") == "ai")
    counts = marked.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ai).alias("n_ai"), F.count_if(F.col("asked") & (F.col("route") == "rule_only")).alias("n_rule_only"),
        F.count_if(F.col("asked") & (F.col("route") == "skipped")).alias("n_skipped"), F.count_if(~F.col("asked")).alias("n_already"),
    )
    single = marked.where(ai).groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"), F.min("tokens_in").alias("tokens_in"), F.min("max_tokens").alias("max_tokens"))
    held = cache.select(F.col("cache_key").alias("held_key")).distinct()
    found = single.join(held, F.col("cache_key") == F.col("held_key"), "left")
    called = F.col("held_key").isNull()
    requests = found.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(~called).alias("n_cached"), F.count_if(called).alias("n_calls"),
        F.coalesce(F.sum(F.when(called, F.col("tokens_in"))), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.when(called, F.col("max_tokens"))), F.lit(0)).alias("tokens_out"),
    )
    minutes = F.col("n_calls") * seconds / 60.0 / concurrency
    return counts.crossJoin(requests).withColumn("minutes", minutes)  # one row and one row


def level_counts(issues: DataFrame) -> DataFrame:
    """Issues a level, and whether they stop the output."""
    return issues.groupBy("level").agg(F.sum("n").alias("n")).withColumn("blocks", F.col("level") == "error")
