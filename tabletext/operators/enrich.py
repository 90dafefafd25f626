"""Language-model enrichment as joins: routing, request keys, one call for equal requests, cache, staleness, verification."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions.text import numbers_in


def route(text: str, min_chars: int = 0, contains: list[str] | None = None, max_tokens: Column | None = None) -> Column:
    """``skipped`` for blank texts, ``rule_only`` where a condition fails, else ``ai``."""
    t = F.coalesce(F.col(text), F.lit(""))
    run = F.length(t) >= min_chars
    for word in contains or []:
        run &= F.contains(t, F.lit(word))
    if max_tokens is not None:
        run &= max_tokens <= 6000
    return F.when(F.trim(t) == "", "skipped").when(run, "ai").otherwise("rule_only")


def run_if(rule: dict, segments: Column, text: Column) -> Column:
    """A JSON condition as a Column: any, all, min_segments, min_chars, contains."""
    tests = []
    for name, value in rule.items():
        if name in ("any", "all"):
            parts = [run_if(r, segments, text) for r in value]
            joined = parts[0] if parts else F.lit(name == "all")
            for p in parts[1:]:
                joined = (joined | p) if name == "any" else (joined & p)
            tests.append(joined)
        elif name == "min_segments":
            tests.append(segments >= value)
        elif name == "min_chars":
            tests.append(F.length(text) >= value)
        elif name == "contains":
            words = [value] if isinstance(value, str) else value
            found = F.contains(text, F.lit(words[0]))
            for w in words[1:]:
                found |= F.contains(text, F.lit(w))
            tests.append(found)
        else:
            raise ValueError(f"unknown condition {name!r}")
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out &= t
    return out


def cache_key(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts]), 256)


def one_request_each(works: DataFrame, key: str) -> DataFrame:
    """One row a key, with how many rows share it."""
    return works.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def missing(works: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return works.join(cache.select(key).distinct(), key, "left_anti")


def fan_out(works: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    return works.join(responses, key)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def is_stale(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        out |= ~F.col(a).eqNullSafe(F.col(b))
    return out


def unsupported_numbers(value: str, source: str) -> Column:
    """Numbers of an answer that its source does not hold."""
    return F.array_except(numbers_in(value), numbers_in(source))


def call(requests: DataFrame, client: Callable[[str], str], key: str = "cache_key", prompt: str = "prompt", attempts: int = 3) -> DataFrame:
    """Answers (key, answer, error) of an injected client, one call a row; parallelism is the number of partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, p in zip(frame[key], frame[prompt], strict=True):
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = client(p), None
                        break
                    except (TimeoutError, ConnectionError) as e:
                        error = str(e)
                rows.append((k, answer, error))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    return requests.select(key, prompt).mapInPandas(run, f"{key} string, answer string, error string")


def json_of(answer: str) -> Column:
    """The JSON object in an answer: fences and thinking sections are taken off."""
    bare = F.regexp_replace(F.col(answer), "(?s)<think>.*?</think>", "")
    return F.regexp_extract(bare, "(?s)(\\{.*\\})", 1)


def stable_json(value: object) -> str:
    """Canonical JSON: sorted keys, no spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def estimate(df: DataFrame, tokens: Column, by: list[str], concurrency: int = 4, seconds: float = 8.0) -> DataFrame:
    """Rows, 75th percentile of tokens, total and minutes a group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.percentile(tokens, F.lit(0.75)).alias("p75")).withColumn(
        "total_tokens", F.col("n_rows") * F.col("p75")
    ).withColumn("minutes", F.col("n_rows") * F.lit(seconds) / F.lit(60.0 * concurrency))
