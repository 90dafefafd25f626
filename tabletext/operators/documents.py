"""Rendering: groups of records to size-bounded files, titles, names and splits."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletext.session import stored

#: Characters of a file, and estimated tokens of a block, at most.
FILE_CHARS, BLOCK_TOKENS = 700_000, 400


def dated_first(date: str, *then: str) -> list[Column]:
    """Record order: rows with a date first, by date, then by the other columns."""
    return [F.col(date).isNull(), F.col(date), *[F.col(c) for c in then]]


def positions(df: DataFrame, order: list[Column], out: str = "position", ranges: int | None = None) -> DataFrame:
    """Adds the place of each row in a total order, from 1: its number within a range of the order, and the rows of the ranges before.

    Bounds come from some hundred keys a range, drawn by hash; the range of a row depends on its keys alone, so a rerun
    counts and numbers alike.
    """
    keys = [f"place_{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 100 * ranges / max(1, df.count()))
    few = F.pmod(F.xxhash64(*keys), F.lit(10**9)) < F.lit(int(share * 10**9))
    drawn = rows.where(few).select(*keys).distinct().orderBy(*keys).collect()
    kinds = [rows.schema[k].dataType for k in keys]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, r, kinds, strict=True)]) for r in drawn[:: max(1, len(drawn) // ranges)][1:]]
    at = F.size(F.filter(F.array(*bounds), lambda b: b <= F.struct(*keys))) if bounds else F.lit(0)
    rows = rows.withColumn("place_range", at)
    counts = rows.groupBy("place_range").agg(F.count(F.lit(1)).alias("place_rows"))
    before = F.sum("place_rows").over(W.orderBy("place_range")) - F.col("place_rows")  # over one row a range
    starts = F.broadcast(counts.select("place_range", before.alias("place_before")))
    turn = F.row_number().over(W.partitionBy("place_range").orderBy(*keys))
    placed = rows.withColumn("place_turn", turn).join(starts, "place_range")
    return placed.withColumn(out, (F.col("place_before") + F.col("place_turn")).cast("bigint")).select(*df.columns, out)


def title_suffixes(df: DataFrame, title: str, by: list[str], row: str, out: str = "title") -> DataFrame:
    """Titles that occur more than once in a file get their row number."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by, title))
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(title), F.lit("（"), F.col(row).cast("string"), F.lit("行目）"))).otherwise(F.col(title)))


def neighbours(df: DataFrame, name: str, by: list[str], order: str) -> DataFrame:
    """Names of the file before and after in the group."""
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("prev_name", F.lag(name).over(w)).withColumn("next_name", F.lead(name).over(w))


def record_spans(df: DataFrame, by: list[str], order: list[Column | str], key: str, row: str) -> DataFrame:
    """(by, n_records, first_key, last_key, first_row, last_row) of each file; rows only where they follow each other without gaps."""
    place = F.struct(*order)
    found = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"), F.min_by(key, place).alias("first_key"), F.max_by(key, place).alias("last_key"), F.min(row).alias("a"), F.max(row).alias("b")
    )
    whole = F.col("b") - F.col("a") + 1 == F.col("n_records")
    return found.select(*by, "n_records", "first_key", "last_key", F.when(whole, F.col("a")).alias("first_row"), F.when(whole, F.col("b")).alias("last_row"))


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Names told apart without case by ``_2``, ``_3`` before the extension, in order."""
    turn = F.row_number().over(W.partitionBy(F.lower(name)).orderBy(*order))
    stem, ext = F.regexp_extract(name, "^(.*?)(\\.[A-Za-z0-9]+)?$", 1), F.regexp_extract(name, "^(.*?)(\\.[A-Za-z0-9]+)?$", 2)
    return df.withColumn(out, F.when(turn == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), turn.cast("string"), ext)))


#: Rows of a range, about, that a task cuts.
RANGE_ROWS = 1_000_000


def _starts(sums: np.ndarray, target: float) -> np.ndarray:
    """For a part that starts at each row, where the next one starts: before the first row that passes the target, behind its own."""
    before = np.concatenate([[0], sums[:-1]])
    return np.maximum(np.searchsorted(sums, before + target, "right"), np.arange(len(sums)) + 1)


def _range_summary(sums: np.ndarray, target: float) -> tuple[list[float], list[float], list[int]]:
    """What becomes of a part that comes in from the range before: for each row that can start the next part, the running sum
    at it, the size of the part that goes out, and how many parts start behind that row."""
    starts, n = _starts(sums, target), len(sums)
    entries = min(n, int(np.searchsorted(sums, target, "right")) + 1)
    out, more = np.zeros(n), np.zeros(n, np.int64)
    for j in range(n - 1, -1, -1):
        k = starts[j]
        out[j] = sums[-1] - (sums[j - 1] if j else 0) if k == n else out[k]
        more[j] = 0 if k == n else 1 + more[k]
    return sums[:entries].tolist(), out[:entries].tolist(), more[:entries].tolist()


def _row_parts(sums: np.ndarray, target: float, carried: float, fresh: bool, before: int) -> np.ndarray:
    """The number of the part of each row of a range."""
    starts, n = _starts(sums, target), len(sums)
    first = np.zeros(n, np.int64)
    j = 0 if fresh else int(np.searchsorted(sums, target - carried, "right"))
    if fresh:
        j = int(starts[0])
    while j < n:
        first[j] = 1
        j = int(starts[j])
    return before + np.cumsum(first)


def part_sizes(df: DataFrame, by: list[str], order: list[Column | str], size: str, limit: int = FILE_CHARS) -> DataFrame:
    """Adds ``part``, ``parts`` and ``place`` (in the group): each group is cut where the size of a part would pass an equal share of its total.

    The number of parts is total / limit, rounded up; the last part takes what is left. Rows are sorted into ranges of groups
    and order, whatever the groups' sizes. Every range says, for each row that can start its first part, what goes out of it;
    a walk over these summaries (one row a group and range) tells each range what comes in, and the ranges number their rows.
    """
    spark = df.sparkSession
    keys = [f"cut_key_{i}" for i in range(len(by))]
    places = [f"cut_order_{i}" for i in range(len(order))]
    rows = df.select("*", *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[(F.col(o) if isinstance(o, str) else o).alias(p) for o, p in zip(order, places, strict=True)])
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS + 1)
    sorted_ = rows.repartitionByRange(ranges, *keys, *places).sortWithinPartitions(*keys, *places)
    # the numbers of rows are those of the written table, also if tasks run again later
    rows = stored(sorted_.drop(*places).withColumn("cut_at", F.monotonically_increasing_id()))
    narrow = rows.select(F.shiftright("cut_at", 33).cast("int").alias("cut_range"), *keys, F.col(size).cast("double").alias("cut_size"), "cut_at")
    spans = narrow.groupBy("cut_range", *keys).agg(F.sum("cut_size").alias("cut_sum"), F.count(F.lit(1)).alias("cut_rows"))
    spans = stored(spans)
    totals = spans.groupBy(*keys).agg(F.sum("cut_sum").alias("total"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("bigint")
    totals = totals.withColumn("parts", parts).withColumn("target", F.col("total") / F.col("parts"))
    # keys may be null; equal ones are told by other names on one side of a join
    renamed = {k: f"{k}_of" for k in keys}
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in renamed.items()], F.lit(True))
    numbered = spans.join(totals.withColumnsRenamed(renamed), same).select("cut_range", *keys, "cut_rows", "parts", "target")
    numbered = stored(numbered.withColumn("cut_span", F.monotonically_increasing_id()))
    narrow = narrow.join(numbered.drop("cut_rows", "parts").withColumnsRenamed(renamed | {"cut_range": "range_of"}), same & (F.col("cut_range") == F.col("range_of")))
    narrow = narrow.select("cut_range", "cut_span", "cut_at", "cut_size", "target")

    def by_span(table: pa.Table) -> Iterator[tuple[int, float, pa.Table, np.ndarray]]:
        table = table.sort_by("cut_at")
        span = table.column("cut_span").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(span)) + 1, [len(span)]]).tolist() if len(span) else [0]
        for i, j in itertools.pairwise(edges):
            own = table.slice(i, j - i)
            yield int(span[i]), own.column("target")[0].as_py(), own, np.cumsum(own.column("cut_size").to_numpy())

    def summarize(table: pa.Table) -> pa.Table:
        found = [(span, float(sums[-1]), *_range_summary(sums, target)) for span, target, _, sums in by_span(table)]
        kinds = [("cut_span", pa.int64()), ("sum", pa.float64()), ("sums", pa.list_(pa.float64())), ("out", pa.list_(pa.float64())), ("more", pa.list_(pa.int64()))]
        return pa.table({name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(kinds)})

    summaries = narrow.groupBy("cut_range").applyInArrow(summarize, "cut_span long, sum double, sums array<double>, out array<double>, more array<long>")
    summaries = numbered.join(summaries, "cut_span").withColumn("cut_group", F.xxhash64(*keys))

    def walk(table: pa.Table) -> pa.Table:
        """What comes into each range of a group, from the first one on."""
        done = []
        state: dict = {}
        for r in sorted(table.to_pylist(), key=lambda r: r["cut_range"]):
            group = tuple(r[k] for k in keys)
            carried, cuts, place, fresh = state.get(group, (0.0, 0, 0, True))
            done.append((r["cut_span"], carried, cuts, place, fresh, r["parts"]))
            j = 0 if fresh else int(np.searchsorted(np.array(r["sums"]), r["target"] - carried, "right"))
            if fresh or j < len(r["sums"]):
                carried, cuts = r["out"][j], cuts + r["more"][j] + (not fresh)
            else:
                carried += r["sum"]
            state[group] = carried, cuts, place + r["cut_rows"], False
        kinds = [("cut_span", pa.int64()), ("carried", pa.float64()), ("cuts", pa.int64()), ("before", pa.int64()), ("fresh", pa.bool_()), ("parts", pa.int64())]
        return pa.table({name: pa.array([d[i] for d in done], kind) for i, (name, kind) in enumerate(kinds)})

    incoming = stored(summaries.groupBy("cut_group").applyInArrow(walk, "cut_span long, carried double, cuts long, before long, fresh boolean, parts long"))

    def number(table: pa.Table, known: pa.Table) -> pa.Table:
        state = {r["cut_span"]: r for r in known.to_pylist()}
        out = [[], [], [], []]
        for span, target, own, sums in by_span(table):
            s = state[span]
            part = np.minimum(_row_parts(sums, target, s["carried"], s["fresh"], s["cuts"]), s["parts"] - 1) + 1
            for x, y in zip(out, (own.column("cut_at").to_numpy(), part, np.full(len(part), s["parts"]), s["before"] + np.arange(1, len(part) + 1)), strict=True):
                x.append(y)
        names = ["cut_row", "part", "parts", "place"]
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for n, x in zip(names, out, strict=True)})

    incoming = incoming.join(numbered.select("cut_span", F.col("cut_range").alias("in_range")), "cut_span")
    placed = narrow.groupBy("cut_range").cogroup(incoming.groupBy("in_range")).applyInArrow(number, "cut_row long, part long, parts long, place long")
    return rows.join(placed, F.col("cut_at") == F.col("cut_row")).select(*df.columns, "part", "parts", "place")


class TokenCounts:
    """Token estimates of any ranges of a text, by running sums."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        digit = (code >= 48) & (code <= 57)
        mark = (code >= 33) & (code <= 126) & ~digit & ~((code >= 65) & (code <= 90)) & ~((code >= 97) & (code <= 122))
        inner = digit.copy()  # goes on a run of digits
        inner[1:] &= digit[:-1]
        inner[:1] = False
        weight = np.select([code > 127, digit, mark], [33, 10, 30], 15) + 30 * (digit & ~inner)
        self.sums, self.inner = array("q", bytes(8)), inner.tobytes()
        self.sums.frombytes(np.cumsum(weight, dtype=np.int64).tobytes())

    def __call__(self, start: int, end: int) -> int:
        cut_run = 30 if start < end and self.inner[start] else 0
        return -(-(self.sums[end] - self.sums[start] + cut_run) // 30)


#: Signs that a text is cut behind, coarsest first.
CUTS = ["。", "！？!?", "、，,", ".;:", " \n"]


def text_pieces(text: str, budget: int) -> list[str]:
    """Cut a text at sentence ends, then commas, spaces and characters, so that each piece keeps to the budget; the pieces joined are the text."""
    size = TokenCounts(text)
    if size(0, len(text)) <= budget or len(text) < 2:
        return [text]
    ends = [[m.end() for m in re.finditer(f"[{re.escape(signs)}]", text)] for signs in CUTS]

    def cut(start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        if size(start, end) <= budget or end - start < 2:
            yield start, end
        elif level == len(CUTS):
            half = start + (end - start) // 2
            yield from cut(start, half, level)
            yield from cut(half, end, level)
        else:
            inside = ends[level][bisect.bisect_right(ends[level], start) : bisect.bisect_left(ends[level], end)]
            for a, b in itertools.pairwise([start, *inside, end]):
                yield from cut(a, b, level + 1)

    pieces: list[list[int]] = []
    total = 0
    for start, end in cut(0, len(text), 0):
        n = size(start, end)
        if pieces and total + n + 1 <= budget:
            pieces[-1][1], total = end, total + n + 1
        else:
            pieces.append([start, end])
            total = n
    return [text[a:b] for a, b in pieces]


def split_texts(df: DataFrame, text: str, budget: int = BLOCK_TOKENS, out: str = "pieces") -> DataFrame:
    """Adds the pieces of each text, at most ``budget`` estimated tokens each."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda t: None if t is None else text_pieces(t, budget))

    return df.withColumn(out, pieces(text))


def file_groups(records: DataFrame, group: list[str], order: list[Column], block: str, limit: int = FILE_CHARS) -> DataFrame:
    """Records to files: one row a (group, part) with its text, name parts and record span. A file holds ``limit`` characters, or one record more."""
    sized = records.select(*group, F.col(block).alias("file_block"), (F.length(block) + 1).alias("file_size"), *[o.alias(f"file_order_{i}") for i, o in enumerate(order)])
    cut = part_sizes(sized, group, [f"file_order_{i}" for i in range(len(order))], "file_size", limit)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("file_block").alias("b")))), lambda x: x["b"]), "\n\n")
    return cut.groupBy(*group, "part", "parts").agg(
        joined.alias("text"), F.count(F.lit(1)).alias("n_records"), F.min("place").alias("first_record"), F.max("place").alias("last_record")
    )


def month_label(month: Column | str) -> Column:
    """``2026年4月`` of ``2026-04``."""
    m = F.col(month) if isinstance(month, str) else month
    return F.concat(F.substring(m, 1, 4), F.lit("年"), F.substring(m, 6, 2).cast("int").cast("string"), F.lit("月"))


def file_headers(files: DataFrame, table: str, group: str, name: str, out: str = "header") -> DataFrame:
    """Adds the head of each file of ``file_groups``: what it holds, the period if the group is a month, its part and its neighbours.

    ``group`` is a month (``YYYY-MM``), another value, or empty; ``name`` is the file's name. A file that is not split names all
    records of its group; the part of a split one names its range of records and the files before and after it.
    """
    g = F.coalesce(F.col(group), F.lit(""))
    is_month = g.rlike("^[0-9]{4}-(?:0[1-9]|1[0-2])$")
    split, count = F.col("parts") > 1, lambda c: F.format_number(c, 0)
    scope = F.when(is_month, month_label(g)).when(g != "", g).otherwise(F.lit("全件"))
    title = F.concat(F.lit(f"# {table}"), F.when(g != "", F.concat(F.lit(" "), F.when(is_month, month_label(g)).otherwise(g))).otherwise(F.lit("")), F.lit("の記録"))
    title = F.concat(title, F.when(split, F.concat(F.lit("（"), F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit("）"))).otherwise(F.lit("")))
    first = F.try_to_date(F.concat(g, F.lit("-01")), "yyyy-MM-dd")
    period = F.concat(F.when(split, F.lit("- まとまり全体の対象期間: ")).otherwise(F.lit("- 対象期間: ")), first.cast("string"), F.lit("〜"), F.last_day(first).cast("string"))
    everything = F.when(scope == "全件", scope).otherwise(F.concat(scope, F.lit("の全件")))
    some = F.concat(scope, F.lit("の"), count(F.col("whole")), F.lit("件のうち"), count(F.col("first_record")), F.lit("〜"), count(F.col("last_record")), F.lit("件目"))
    lines = F.array(
        F.lit(f"- データ種別: {table}（1行＝1件）の記録"),
        F.when(is_month, period),
        F.concat(F.lit("- このファイルの記録: "), count(F.col("n_records")), F.lit("件（"), F.when(split, some).otherwise(everything), F.lit("）")),
        F.when(split, F.concat(F.lit("- 前のファイル: "), F.coalesce("prev_name", F.lit("なし（これが最初）")))),
        F.when(split, F.concat(F.lit("- 次のファイル: "), F.coalesce("next_name", F.lit("なし（これが最後）")))),
    )
    # of narrow rows: counts of groups, and the names of the parts before and behind
    named = files.select(F.col(group).alias("of_group"), F.col("part").alias("of_part"), F.col(name).alias("of_name"), "n_records")
    counts = named.groupBy("of_group").agg(F.sum("n_records").alias("whole"))
    placed = files.join(counts, F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group")
    for column, step in (("prev_name", 1), ("next_name", -1)):
        other = named.select("of_group", (F.col("of_part") + step).alias("of_part"), F.col("of_name").alias(column))
        placed = placed.join(other, F.col(group).eqNullSafe(F.col("of_group")) & (F.col("part") == F.col("of_part")), "left").drop("of_group", "of_part")
    return placed.withColumn(out, F.concat(title, F.lit("\n\n"), F.array_join(F.array_compact(lines), "\n"))).drop("whole", "prev_name", "next_name")
