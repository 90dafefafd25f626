"""Row-to-record operators: ordered work as windows over (partition, order), so one exchange and one sort serve all.

Every function takes a total order key, since rows of a sheet have positions and results must not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.functions.text import is_ditto


def over_rows(by: list[str], order: list[str]) -> W:
    return W.partitionBy(*by).orderBy(*order)


def fill_down(df: DataFrame, column: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Blanks take the last value above them."""
    w = over_rows(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.last(F.when(F.col(column) != "", F.col(column)), ignorenulls=True).over(w))


def ditto_fill(df: DataFrame, column: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Ditto marks take the value of the row before, which may itself be filled; a mark in the first row stays.

    Rows up to the next value that is no mark form an island, whose first row holds that value.
    """
    w = over_rows(by, order)
    mark = is_ditto(column)
    island = F.sum(F.when(mark, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    df = df.withColumn("_island", island)
    first = F.first(column).over(W.partitionBy(*by, "_island").orderBy(*order))
    return df.withColumn(out, F.when(mark, first).otherwise(F.col(column))).drop("_island")


def record_number(df: DataFrame, starts: Column, by: list[str], order: list[str], out: str = "record_no") -> DataFrame:
    """Number of the record a row belongs to: continuation rows share that of the last row that starts one."""
    w = over_rows(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def merge_continuations(df: DataFrame, starts: Column, text: str, by: list[str], order: list[str]) -> DataFrame:
    """One row a record: texts of its rows joined by line feeds, in order. Rows before the first start are record 0."""
    numbered = record_number(df, starts, by, order)
    parts = F.sort_array(F.collect_list(F.struct(*order, text)))
    return numbered.groupBy(*by, "record_no").agg(
        F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias(text), F.count(F.lit(1)).alias("n_rows"), *[F.min(o).alias(o) for o in order]
    )


def record_keys(df: DataFrame, parts: list[str], order: list[str], fallback: list[str] = (), out: str = "record_key") -> DataFrame:
    """Key ``a|b`` of all parts; else the first fallback that is filled; else the row; repeats get ``#2``, ``#3`` in order."""
    text = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    whole = F.array_join(F.array(*text), "|")
    full = F.forall(F.array(*text), lambda p: p != "")
    others = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.col(f).cast("string")) for f in fallback]
    base = F.coalesce(F.when(full, whole), *others, F.concat(F.lit("行"), F.concat_ws("-", *[F.col(o).cast("string") for o in order[:1]])))
    df = df.withColumn("_base", base)
    turn = F.row_number().over(W.partitionBy("_base").orderBy(*order))
    return df.withColumn(out, F.when(turn == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("#"), turn.cast("string")))).drop("_base")


def key_prefix(c: Column | str, n: int) -> Column:
    """A key part cut to its first n characters that are not white space."""
    return F.substring(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "(?U)\\s", ""), 1, n)


def expand_merged(cells: DataFrame, by: list[str], data_start: int) -> DataFrame:
    """Blank members of merged cells take the anchor's text, if the anchor lies in the data.

    Cells are rows (by..., row, col, text, anchor_row, anchor_col), anchors null for cells that are not merged.
    """
    anchors = cells.where(F.col("row") >= data_start).select(
        *[F.col(b).alias(f"_{b}") for b in by], F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("text").alias("_text")
    )
    same = [F.col(b) == F.col(f"_{b}") for b in by] + [F.col("anchor_row") == F.col("_row"), F.col("anchor_col") == F.col("_col")]
    on = same[0]
    for s in same[1:]:
        on &= s
    filled = F.when((F.coalesce("text", F.lit("")) == "") & F.col("_text").isNotNull(), F.col("_text")).otherwise(F.col("text"))
    return cells.join(anchors, on, "left").withColumn("text", filled).select(*cells.columns)


def reconcile(df: DataFrame, value: str, subtotal: Column, by: list[str], order: list[str]) -> DataFrame:
    """On subtotal rows: the stated value, the sum since the last subtotal, the grand sum so far, and the difference."""
    w = over_rows(by, order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    island = F.coalesce(F.sum(F.when(subtotal, 1).otherwise(0)).over(before), F.lit(0))
    own = F.when(~subtotal, F.col(value)).otherwise(0)
    df = df.withColumn("_island", island).withColumn("_own", own).withColumn("_sub", subtotal)
    df = df.withColumn("grand_sum", F.sum("_own").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    df = df.withColumn("running_sum", F.sum("_own").over(W.partitionBy(*by, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return df.where("_sub").withColumn("difference", F.col(value) - F.col("running_sum")).drop("_island", "_own", "_sub")


def blank_runs(df: DataFrame, blank: Column, by: list[str], order: list[str], out: str = "blank_run") -> DataFrame:
    """Length so far of the run of blank rows a row lies in, 0 for others."""
    w = over_rows(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_filled", F.sum(F.when(blank, 0).otherwise(1)).over(w)).withColumn("_blank", blank.cast("int"))
    run = F.sum("_blank").over(W.partitionBy(*by, "_filled").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn(out, F.when(F.col("_blank") == 1, run).otherwise(0)).drop("_filled", "_blank")


def append_link(text: str, link: str) -> Column:
    """``text（link）`` unless the text holds the link already."""
    t, u = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(link), F.lit(""))
    return F.when((u == "") | F.contains(t, u), t).when(t == "", u).otherwise(F.concat(t, F.lit("（"), u, F.lit("）")))
