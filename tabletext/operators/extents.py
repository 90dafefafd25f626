"""Extents of tables: a sheet is cut into blocks, downwards and across, each of which is read as a sheet of its own.

Downwards: behind blank rows another table starts where a row of words stands over rows of other kinds and does not look like
the rows above (the kinds of its columns against the most frequent ones of the last rows), or where a lone title stands over
such a row. Across: between columns that are blank in the header and nearly blank below, where two headers or more stand on
the right. A single header far away is a note and left out, if nothing stands below it.

The first block keeps the sheet's name, the others get ``［2］``, ``［3］`` and so on, from top to bottom and left to right; row
numbers stay those of the sheet. Kinds of the rows around come from windows of bounded length; the shape of a block is
decided from its first rows. Edge cases: a sheet without a header is one block; blank rows belong to the block above.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.functions.text import let
from tabletext.session import by_sheets, stored

#: Rows above and below that a row is compared with, rows that decide the shape of a block.
NEAR_ROWS, HEAD_ROWS = 12, 80
#: Share of columns of equal kinds from which rows are alike, share of rows from which a column is filled.
ALIKE, FILLED = 0.8, 0.1
#: Columns between the header and a lone cell that is no part of it.
FAR = 20
VALUE = "[-+△▲¥]?[0-9][0-9,./:% -]*"


def cell_kind(text: Column) -> Column:
    """One letter: blank, value, code, text or word."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "b").when(t.rlike(f"^{VALUE}$"), "v").when((F.length(t) > 40) | t.contains("\n"), "t").when(t.rlike("^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9_./#-]+$"), "c").otherwise("w")


def _alike(kinds: Column, rows: Column) -> Column:
    """Whether most filled columns of a row have the kind that most of some rows have there; false without rows."""
    filled = F.filter(F.transform(kinds, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: x["k"] != "b")
    near = F.filter(rows, lambda r: F.exists(r, lambda k: k != "b"))

    def same(x: Column, near: Column) -> Column:
        own = F.filter(F.transform(near, lambda r: F.coalesce(F.get(r, x["i"]), F.lit("b"))), lambda k: k != "b")
        return let(own, lambda o: (F.size(o) > 0) & (2 * F.size(F.filter(o, lambda k: k == x["k"])) >= F.size(o)))

    return let(near, lambda n: (F.size(n) > 0) & (F.size(F.filter(filled, lambda x: same(x, n))) >= ALIKE * F.size(filled)))


def row_blocks(rows: DataFrame) -> DataFrame:
    """Adds ``block`` (from 1) and ``block_row``: the table, downwards, that a row belongs to, and its place in it."""
    sheet = W.partitionBy("file", "sheet").orderBy("row_index")
    upto = sheet.rowsBetween(W.unboundedPreceding, W.currentRow)
    kinds = F.transform("cells", lambda c: cell_kind(c["text"]))
    df = rows.withColumn("x_kinds", kinds)
    filled = F.size(F.filter("x_kinds", lambda k: k != "b"))
    df = df.withColumn("x_n", filled).withColumn("x_above", F.collect_list("x_kinds").over(sheet.rowsBetween(-NEAR_ROWS, -1)))
    df = df.withColumn("x_below", F.collect_list("x_kinds").over(sheet.rowsBetween(1, NEAR_ROWS)))
    words = F.forall("x_kinds", lambda k: k.isin("b", "w")) & (F.col("x_n") >= 2)
    # the next two rows are filled (or the one that is left), and some column of words stands over values
    under = F.slice("x_below", 1, 2)
    over_values = F.exists(under, lambda r: F.exists(F.zip_with("x_kinds", r, lambda a, b: (a == "w") & b.isin("v", "c")), lambda x: F.coalesce(x, F.lit(False))))
    table = words & (F.size(under) > 0) & F.forall(under, lambda r: F.size(F.filter(r, lambda k: k != "b")) >= 2) & over_values
    df = df.withColumn("x_header", table & ~_alike(F.col("x_kinds"), F.col("x_below")) & ~_alike(F.col("x_kinds"), F.col("x_above")))
    df = df.withColumn("x_open", F.coalesce(F.lag("x_n").over(sheet) == 0, F.lit(True)) & (F.col("x_n") > 0))
    titled = (F.col("x_n") == 1) & F.coalesce(F.lead("x_header").over(sheet), F.lit(False))
    starts = F.col("x_open") & (F.col("x_header") | titled)
    df = df.withColumn("x_starts", starts)
    number = F.greatest(F.lit(1), F.sum(F.col("x_starts").cast("int")).over(upto)).cast("int")
    df = df.withColumn("block", number).drop("x_kinds", "x_n", "x_above", "x_below", "x_header", "x_open", "x_starts")
    return df.withColumn("block_row", F.row_number().over(W.partitionBy("file", "sheet", "block").orderBy("row_index")))


def column_spans(rows: list[list[str | None]], header: int) -> list[tuple[int, int]]:
    """(first, behind the last) column of each table across, of the first rows of a block and the place of its header."""
    width = max((len(r) for r in rows), default=0)
    has = [[bool((r[c] if c < len(r) else None) or "") and bool(r[c].strip()) for c in range(width)] for r in rows]
    named = has[header] if has else []
    if header and any(has[header - 1]) and sum(has[header - 1]) > 1:  # an upper row of a header of two
        named = [a or b for a, b in zip(named, has[header - 1], strict=True)]
    below = [h for h in has[header + 1 : header + 31] if any(h)]
    used = [sum(h[c] for h in below) > FILLED * len(below) if below else False for c in range(width)]
    columns = [c for c in range(width) if named[c]] if named else []
    if not columns:
        return [(0, width)]
    spans, first, last = [], 0, columns[0]
    for c in [*columns[1:], None]:
        gap = None if c is None else [g for g in range(last + 1, c) if not used[g]]
        if c is not None and gap:
            right = [x for x in columns if x >= c]
            if len(right) == 1 and c - last > FAR and not used[c]:
                break  # a lone note
            if len(right) >= 2:
                spans.append((first, last + 1))
                first = c
        last = c if c is not None else last
    while last + 1 < width and used[last + 1]:
        last += 1  # values go on without headers
    return [*spans, (first, last + 1)]


def cut_blocks(rows: DataFrame, header_of) -> DataFrame:
    """The rows of every block under the name of a sheet of its own, with ``block_row``.

    ``header_of`` tells the place of the header among the first rows of a block, from their texts, or -1.
    """
    good = rows.where("error IS NULL")
    # another block starts behind a blank row only: a sheet without one is one block, and its rows need no window
    empty = F.forall("cells", lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) == "")
    first, last = F.min("row_index"), F.max("row_index")
    sheets = stored(good.groupBy("file", "sheet").agg(first.alias("x_first"), ((F.count_if(empty) > 0) | (last - first + 1 != F.count(F.lit(1)))).alias("x_parted")))
    numbered = by_sheets(
        good, sheets, "x_parted",
        lambda df: df.withColumn("block", F.lit(1)).withColumn("block_row", F.col("row_index") - F.col("x_first") + 1).select(*rows.columns, "block", "block_row"),
        lambda df: stored(row_blocks(df.select(*rows.columns))),
    )

    def spans(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_index")
        texts = [list(t) for t in frame["texts"]]
        at = header_of(texts)
        found = column_spans(texts, at) if at >= 0 else [(0, max((len(t) for t in texts), default=0))]
        return pd.DataFrame([{"file": key[0], "sheet": key[1], "block": key[2], "first": a, "behind": b, "open": b == found[-1][1] and len(found) == 1 and at < 0} for a, b in found])

    head = numbered.where(f"block_row <= {HEAD_ROWS}").select("file", "sheet", "block", "row_index", F.transform("cells", lambda c: c["text"]).alias("texts"))
    shape = "file string, sheet string, block int, first int, behind int, open boolean"
    found = head.groupBy("file", "sheet", "block").applyInPandas(spans, shape)
    turn = F.row_number().over(W.partitionBy("file", "sheet").orderBy("block", "first"))
    found = stored(found.withColumn("turn", turn).withColumnsRenamed({"file": "x_file", "sheet": "x_sheet", "block": "x_block"}))
    same = (F.col("file") == F.col("x_file")) & (F.col("sheet") == F.col("x_sheet")) & (F.col("block") == F.col("x_block"))
    cut = numbered.join(found, same)
    own = F.slice("cells", F.col("first") + 1, F.when(F.col("open"), F.size("cells")).otherwise(F.col("behind") - F.col("first")))
    moved = F.transform(own, lambda c: c.withField("anchor_col", (c["anchor_col"] - F.col("first")).cast("int")))
    name = F.when(F.col("turn") > 1, F.concat("sheet", F.lit("［"), F.col("turn").cast("string"), F.lit("］"))).otherwise(F.col("sheet"))
    blocks = cut.withColumn("cells", F.when(F.col("first") > 0, moved).otherwise(own)).withColumn("sheet", name).select(*rows.columns, "block_row")
    return blocks.unionByName(rows.where("error IS NOT NULL").withColumn("block_row", F.lit(None).cast("int")))
