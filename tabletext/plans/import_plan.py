"""Files to records and issues: the whole read as one DataFrame plan over all files and sheets.

The cells of a row are an array of entries, one a column, so that sheets with any columns share one schema. Only sheets with
blank rows, continuations, merged cells, ditto marks or columns to fill go through windows and groups; records are maps from
column key to value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.functions import text as tx
from tabletext.functions import values as vl
from tabletext.operators import columns, extents, layout
from tabletext.operators.checks import BLOCK_RATE, WARN_RATE
from tabletext.plans.spec import TableSpec, apply_values, columns_of, spec_issues, validate
from tabletext.session import by_sheets, stored
from tabletext.sources.files import read_files


@dataclass
class Imported:
    records: DataFrame
    issues: DataFrame
    subtotals: DataFrame
    columns: DataFrame
    rows: DataFrame


def cell_value(text: Column, kind: Column, unit: Column, fiscal_year: Column | int | None = None, year: Column | int | None = None) -> Column:
    """Struct (value, failed, year_missing, year_inferred) of a text without outer white space: unreadable values stay as they are written.

    Only what the type asks for is computed; it is meant for lambdas over the cells of a row.
    """
    no = F.lit(False)
    made = lambda value, failed=no, missing=no, inferred=no: F.struct(value.alias("value"), failed.alias("failed"), missing.alias("year_missing"), inferred.alias("year_inferred"))
    # the characters that words for nothing and errors start with, then the words themselves
    none = (text == "") | (text.rlike("^[-－ー―—nNｎＮな該#＃]") & (tx.is_na(text) | tx.is_excel_error(text)))
    number, dated, date = kind == "number", kind.isin("date", "datetime"), kind == "date"
    written = vl.number_unit(text)
    factor = tx.let(written, lambda u: F.when(u == "", F.lit(1.0)).otherwise(vl.unit_factor(u, unit, tx.let)))
    minutes = F.when(unit.isin("分", "時間", "秒"), vl.duration_minutes(text) * vl.unit_factor(F.lit("分"), unit, tx.let))
    amount = F.coalesce(vl.parse_number(text, tx.let) * factor, minutes)
    shown = lambda a: F.when(a.isNotNull(), F.regexp_replace(F.format_string("%.9f", a), "\\.?0+$", ""))
    # numbers and days in their plain forms need none of the patterns for the others
    bare = text.rlike("^¥?(?:[0-9]{1,3}(?:,[0-9]{3}){1,9}|[0-9]{1,40})(?:\\.[0-9]{1,40})?$")
    amount = F.when(bare, F.translate(text, "¥,", "").cast("double")).otherwise(amount)
    numeric = tx.let(amount, lambda a: made(F.coalesce(shown(a), text), a.isNull()))

    def moment(d: Column) -> Column:
        clock = F.when(d["time"] != "00:00", d["time"])
        day = F.coalesce(vl.month_only(text), F.date_format(d["date"], "yyyy-MM-dd"))
        return tx.let(day, lambda day: made(F.when(date | day.isNull(), F.coalesce(day, text)).otherwise(F.concat_ws(" ", day, clock)), day.isNull(), d["year_missing"], d["year_inferred"]))

    spaced = text.rlike("(?U)\\s")
    words = F.when((kind == "text") | ~spaced, text).when(kind == "code", F.regexp_replace(text, "(?U)\\s+", " ")).otherwise(tx.one_line(text))
    two = lambda x: F.lpad(x, 2, "0")
    iso = tx.let(F.split(F.translate(text, "/.年月日", "----"), "-"), lambda p: F.concat_ws("-", p[0], two(p[1]), two(p[2])))
    whole = tx.let(iso, lambda x: tx.let(F.try_to_date(x, "yyyy-MM-dd").isNull(), lambda no: made(F.when(no, text).otherwise(x), no)))
    day = F.when(text.rlike("^[12][0-9]{3}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?$"), whole).otherwise(tx.let(vl.parse_date(text, year, fiscal_year, bind=tx.let), moment))
    return F.when(none, made(F.lit(None).cast("string"))).when(number, numeric).when(dated, day).otherwise(made(words))


def with_values(rows: DataFrame, fiscal_year: Column | int | None = None, year: Column | int | None = None) -> DataFrame:
    """Adds to each of the ``entries`` of a row what ``cell_value`` makes of its text."""
    # NFKC once a row, in one Arrow pass to which only texts go that it may change; circled marks stay
    odd = F.transform("entries", lambda e: F.when(e["text"].rlike(tx.UNSTABLE), e["text"]))
    rows = rows.withColumn("_plain", tx.nfkc_keep_enclosed_each(F.when(F.exists("entries", lambda e: e["text"].rlike(tx.UNSTABLE)), odd)))

    def valued(e: Column, plain: Column) -> Column:
        text = tx.trim_spaces(F.coalesce(plain, e["text"]))
        value = tx.let(text, lambda t: cell_value(t, e["type"], e["unit"], fiscal_year, year))
        return tx.let(value, lambda v: F.struct(*[e[c].alias(c) for c in ENTRY if c not in SPENT], *[v[c].alias(c) for c in VALUE]))

    return rows.withColumn("entries", F.zip_with("entries", F.coalesce("_plain", F.array().cast("array<string>")), valued)).drop("_plain")


#: Fields of an entry: what is known of a cell and its column, and what is made of its text.
ENTRY = ("col", "key", "role", "type", "unit", "fill_down", "text", "link", "ditto", "unfilled")
VALUE = ("value", "failed", "year_missing", "year_inferred")
SPENT = ("col", "unit", "fill_down")


def _filled_from_above(rows: DataFrame) -> DataFrame:
    """Ditto marks, then fill-down, each within a column: for sheets that have marks or columns to fill."""
    own = [c for c in rows.columns if c != "entries"]
    long = rows.select(*own, F.explode("entries").alias("e")).select(*own, "e.*")
    column = W.partitionBy("file", "sheet", "col", "key").orderBy("row_index")
    above = column.rowsBetween(W.unboundedPreceding, W.currentRow)
    ditto = tx.is_ditto("text") & F.col("starts") & ~F.col("role").isin("text", "log", "measure")
    long = long.withColumn("ditto", ditto)
    source = F.last(F.when(~F.col("ditto") & F.col("starts"), F.col("text")), ignorenulls=True).over(above)
    long = long.withColumn("filled_from", source)
    long = long.withColumn("unfilled", F.col("ditto") & F.col("filled_from").isNull()).withColumn("text", F.when(F.col("ditto"), F.coalesce("filled_from", "text")).otherwise(F.col("text")))
    down = F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(above)
    long = long.withColumn("text", F.when(F.col("fill_down") & F.col("starts") & (F.col("text") == ""), F.coalesce(down, F.lit(""))).otherwise(F.col("text")))
    return long.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(*ENTRY))).alias("entries"))


def _joined_continuations(rows: DataFrame) -> DataFrame:
    """One entry a record and column: that of its row, with the texts of its continuations below."""
    done = rows.select("file", "sheet", "row_index", "record_row", "starts", F.explode("entries").alias("e")).select("file", "sheet", "row_index", "record_row", "starts", "e.*")
    texty = F.col("role").isin("text", "log") | (F.col("type") == "text")
    done = done.where(F.col("starts") | (texty & (F.col("text") != "")))
    parts = F.sort_array(F.collect_list(F.when(F.coalesce("value", F.lit("")) != "", F.struct("row_index", "value"))))
    cells = done.groupBy("file", "sheet", "record_row", "key", "role", "type").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"),
        F.max(F.when(F.col("starts"), F.col("text"))).alias("original"),
        F.max(F.when(F.col("starts"), F.col("link"))).alias("link"),
        F.max("failed").alias("failed"),
    )
    return cells.groupBy("file", "sheet", "record_row").agg(F.collect_list(F.struct(*FIELD)).alias("fields"))


#: Fields of a record, as an array beside its place.
FIELD = ("key", "role", "type", "value", "original", "link", "failed")


def _own_fields(rows: DataFrame) -> DataFrame:
    """The fields of records of one row."""
    value = lambda e: F.coalesce(e["value"], F.lit(""))
    fields = F.transform("entries", lambda e: F.struct(e["key"].alias("key"), e["role"].alias("role"), e["type"].alias("type"), value(e).alias("value"), e["text"].alias("original"), e["link"].alias("link"), e["failed"].alias("failed")))
    return rows.select("file", "sheet", "record_row", fields.alias("fields"))


def records_of(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(file, sheet, record_row, values, originals, warnings, key_value, date_value, base, turn, record_key) of rows with values."""
    fields = by_sheets(rows, sheets, "x_continued", _own_fields, _joined_continuations)

    def linked(f: Column) -> Column:
        more = f["type"].isin("string", "text") & f["link"].isNotNull() & ~F.contains(f["value"], f["link"])
        return f.withField("value", F.when(more, F.concat(f["value"], F.lit("（"), f["link"], F.lit("）"))).otherwise(f["value"]))

    def pairs(name: str, which: Callable[[Column], Column]) -> Column:
        return F.map_from_entries(F.transform(F.filter("fields", which), lambda f: F.struct(f["key"].alias("key"), f[name].alias("value"))))

    pick = lambda role: F.array_max(F.transform(F.filter("fields", lambda f: (f["role"] == role) & (f["value"] != "")), lambda f: f["value"]))
    records = fields.withColumn("fields", F.transform("fields", linked)).select(
        "file", "sheet", "record_row",
        pairs("value", lambda f: F.lit(True)).alias("values"),
        pairs("original", lambda f: (f["original"] != f["value"]) & ~f["role"].isin("text", "log")).alias("originals"),
        F.sort_array(F.transform(F.filter("fields", lambda f: f["failed"]), lambda f: F.concat(f["key"], F.lit(": "), f["original"]))).alias("warnings"),
        pick("key").alias("key_value"), pick("date").alias("date_value"),
    )
    base = F.coalesce("key_value", F.concat(F.lit("行"), F.col("record_row").cast("string")))
    turn = F.row_number().over(W.partitionBy("file", "base").orderBy("sheet", "record_row"))
    records = records.withColumn("base", base).withColumn("turn", turn)
    return records.withColumn("record_key", F.when(F.col("turn") == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("turn").cast("string"))))


def read_records(
    spark: SparkSession,
    path: str,
    standards: list[columns.Standard] | None = None,
    fiscal_year: int | None = None,
    year: int | None = None,
    spec: TableSpec | None = None,
    **read: object,
) -> Imported:
    """Read, detect, infer, normalize and check all files under a path. A spec stands in for the inferred columns.

    Days without a year take the given one, else the one that the sheet's title rows, its name or the file's name state.
    """
    if spec is not None:
        if problems := validate(spec):
            raise ValueError("; ".join(problems))
        fiscal_year, year = fiscal_year or spec.fiscal_year, year or spec.year
    # what several steps read is written once. Small tables of sheets and columns are written too, so that their size is known
    # and they are sent to the tasks; rows go through windows over their sheet only where the sheet needs them
    rows = stored(read_files(spark, path, **read))
    words = frozenset(n for s in standards or columns.STANDARDS for n in s.names)
    rows = extents.cut_blocks(rows, lambda texts: layout.header_place(texts, words))
    layouts = stored(layout.detect_layouts(rows, words))
    rows_in = stored(layout.classify(rows, layouts))
    cols = stored(columns.suggest_columns(rows_in, standards) if spec is None else columns_of(spark, spec, layouts))
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    data = F.col("row_kind").isin("data", "continuation")
    sheets = rows_in.groupBy("file", "sheet").agg(
        has(F.col("row_kind") == "continuation").alias("x_continued"), has(F.col("row_kind") == "subtotal").alias("x_totals"),
        has(F.exists("cells", lambda c: c["anchor_row"].isNotNull())).alias("x_merged"), has(data & F.exists("cells", lambda c: tx.is_ditto(c["text"]))).alias("x_above"),
    )
    of_sheet = cols.groupBy("file", "sheet").agg(F.collect_list(F.struct("col", "key", "role", "type", "unit", "fill_down")).alias("x_columns"), F.max("fill_down").alias("x_fill"))
    sheets = sheets.join(of_sheet, ["file", "sheet"]).withColumn("x_above", F.col("x_above") | F.coalesce("x_fill", F.lit(False))).drop("x_fill")
    sheets = stored(sheets)
    flags = lambda *names: sheets.select("file", "sheet", *names)

    own = ["file", "sheet", "row_index", "context_fiscal_year", "context_year", "cells"]
    kept = rows_in.where(data).select(*own, "row_kind")
    sheet = W.partitionBy("file", "sheet").orderBy("row_index")
    # a continuation without a record above it is a record
    starts = (F.col("row_kind") == "data") | (F.row_number().over(sheet) == 1)
    upto = sheet.rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = by_sheets(
        kept, flags("x_continued"), "x_continued",
        lambda df: df.select(*own, F.lit(True).alias("starts"), F.col("row_index").alias("record_row")),
        lambda df: df.withColumn("starts", starts).withColumn("record_row", F.max(F.when(F.col("starts"), F.col("row_index"))).over(upto)).select(*own, "starts", "record_row"),
    )
    own += ["starts", "record_row"]
    kept = by_sheets(kept, flags("x_merged"), "x_merged", lambda df: df.select(*own), lambda df: _with_members(df.select(*own)))

    def entry(s: Column) -> Column:
        new = {"ditto": F.lit(False), "unfilled": F.lit(False)}
        return tx.let(F.get("cells", s["col"]), lambda c: F.struct(
            *[s[n].alias(n) for n in ENTRY[:6]], F.coalesce(c["text"], F.lit("")).alias("text"), c["link"].alias("link"), *[v.alias(n) for n, v in new.items()],
        ))

    # the cells of a row that stand in columns, as an array beside its place
    inside = lambda s: s["col"] < F.size("cells")
    entries = F.transform(F.filter("x_columns", inside), entry)
    own.remove("cells")
    kept = kept.join(flags("x_columns"), ["file", "sheet"]).where(F.exists("x_columns", inside)).select(*own, entries.alias("entries"))
    kept = by_sheets(kept, flags("x_above"), "x_above", lambda df: df.select(*own, "entries"), lambda df: _filled_from_above(df.select(*own, "entries")).select(*own, "entries"))
    given = fiscal_year is not None or year is not None
    kept = with_values(kept, fiscal_year, year) if given else with_values(kept, F.col("context_fiscal_year"), F.col("context_year"))
    # written once: records and issues read it, and no filter of theirs is put before the Arrow pass
    kept = stored(kept.drop("context_fiscal_year", "context_year"))
    records = records_of(kept, flags("x_continued"))
    done = kept.select("file", "sheet", "starts", F.explode("entries").alias("e")).select("file", "sheet", "starts", "e.*")
    subtotals = reconcile_subtotals(rows_in.join(sheets.where("x_totals").select("file", "sheet"), ["file", "sheet"], "left_semi"), cols)
    issues = check(done, records, rows, rows_in, subtotals)
    issues = issues.unionByName(no_date_column(cols))
    if spec is not None:
        issues = issues.unionByName(spec_issues(records, cols, spec)).unionByName(unused_headers(layouts, cols)).unionByName(assumed_units(done, cols, spec))
        records = apply_values(records, spec)
    records = records.select("file", "sheet", "record_row", "record_key", "date_value", "values", "originals", "warnings")
    return Imported(records, issues, subtotals, cols, rows_in)


def _with_members(rows: DataFrame) -> DataFrame:
    """The rows of sheets with merged cells, their blank members filled."""
    long = rows.select("file", "sheet", "row_index", F.posexplode("cells").alias("col", "cell"))
    long = long.select("file", "sheet", "row_index", "col", F.coalesce("cell.text", F.lit("")).alias("text"), "cell.anchor_row", "cell.anchor_col")
    changed = filled_members(long).where("anchor_text IS NOT NULL").groupBy("file", "sheet", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col", "anchor_text"))).alias("x_members"))
    text = lambda c, i: F.coalesce(F.try_element_at("x_members", i), c["text"])
    return rows.join(changed, ["file", "sheet", "row_index"], "left").withColumn("cells", F.transform("cells", lambda c, i: c.withField("text", text(c, i)))).select(*rows.columns)


def filled_members(cells: DataFrame) -> DataFrame:
    """Blank members of merged cells take the anchor's text where the anchor lies in the data."""
    anchors = cells.select("file", "sheet", F.col("row_index").alias("anchor_row"), F.col("col").alias("anchor_col"), F.col("text").alias("anchor_text"))
    members = cells.where("text = '' AND anchor_row IS NOT NULL").select("file", "sheet", "row_index", "col", "anchor_row", "anchor_col")
    members = members.join(anchors.hint("merge"), ["file", "sheet", "anchor_row", "anchor_col"]).select("file", "sheet", "row_index", "col", "anchor_text")
    return cells.join(members.hint("merge"), ["file", "sheet", "row_index", "col"], "left").withColumn("text", F.coalesce("anchor_text", "text"))


def check(cells: DataFrame, records: DataFrame, rows: DataFrame, classified: DataFrame, subtotals: DataFrame) -> DataFrame:
    """(file, sheet, level, code, column, n) of the whole batch."""
    own = cells.where("starts")
    checked = ~tx.is_na("text") & ~tx.is_excel_error("text")
    nobody = F.lit(None).cast("string")

    def issue(level: Column | str, code: Column | str, n: Column, column: Column = nobody) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(n > 0, F.struct(text(level).alias("level"), text(code).alias("code"), column.alias("column"), n.cast("bigint").alias("n")))

    def listed(df: DataFrame, *issues: Column) -> DataFrame:
        """All issues of a row in one pass."""
        return df.select("file", "sheet", F.explode(F.array_compact(F.array(*issues))).alias("i")).select("file", "sheet", "i.*")

    linked = F.col("link").isNotNull() & F.col("type").isin("string", "text") & ~F.contains("text", F.col("link"))
    counts = {
        "checked": checked, "failed": F.col("failed"), "year_missing": F.col("year_missing"), "year_inferred": F.col("year_inferred"), "ditto_filled": F.col("ditto"),
        "ditto_unfilled": F.col("unfilled"), "excel_error": tx.is_excel_error("text"), "cell_link": linked,
    }
    per = own.groupBy("file", "sheet", "key").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    rate = F.col("failed") / F.greatest("checked", F.lit(1))
    key = F.col("key")
    out = listed(
        per, issue(F.when(rate > BLOCK_RATE, "error").otherwise("warning"), "type_error_rate", F.when(rate >= WARN_RATE, F.col("failed")), key),
        *[issue("warning", code, F.col(code), key) for code in counts if code not in ("checked", "failed")],
    )
    # a sheet with rows and no record, not seen among the records, is a group of its own here
    kinds = classified.groupBy("file", "sheet").agg(F.count_if(F.col("row_kind") == "excluded").alias("excluded"), F.first("table_kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    kinds = kinds.select("file", "sheet", "excluded", "kind", "n", F.lit(0).alias("records"), F.lit(0).alias("doubled"), F.lit(0).alias("undated"))
    made = records.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("turn") > 1).alias("doubled"), F.count_if(F.col("date_value").isNull()).alias("undated"))
    sheets = kinds.unionByName(made, allowMissingColumns=True).groupBy("file", "sheet").agg(
        F.max("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("excluded", "n", "records", "doubled", "undated")]
    )
    out = out.unionByName(listed(
        sheets, issue("warning", "duplicate_key", F.col("doubled")), issue("warning", "undated", F.col("undated")), issue("warning", "excluded_rows", F.col("excluded")),
        issue("error", "layout", F.when(F.col("kind") != "list", F.col("n")), F.col("kind")), issue("error", "no_records", F.when(F.col("records") == 0, F.lit(1))),
    ))
    # what the reader noted at a row: an open quote is noted at its record
    noted = rows.where("size(notes) > 0 OR error IS NOT NULL").select("file", "sheet", "error", F.explode_outer("notes").alias("note")).where("note IS NOT NULL OR error IS NOT NULL")
    noted = noted.groupBy("file", "sheet", "note", "error").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("note") == "unclosed_quote", "error").otherwise("warning")
    out = out.unionByName(listed(noted, issue(level, F.col("note"), F.when(F.col("note").isNotNull(), F.col("n"))), issue("error", "unreadable", F.when(F.col("error").isNotNull(), F.lit(1)), F.col("error"))))
    unlike = subtotals.where("NOT agrees").groupBy("file", "sheet", "key").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(listed(unlike, issue("warning", "reconcile", F.col("n"), key)))


def no_date_column(cols: DataFrame) -> DataFrame:
    """An issue for each sheet with columns of which none holds the date of a record."""
    sheets = cols.groupBy("file", "sheet").agg(F.count_if(F.col("role") == "date").alias("dated")).where("dated = 0")
    return sheets.select("file", "sheet", F.lit("warning").alias("level"), F.lit("no_date_column").alias("code"), F.lit(None).cast("string").alias("column"), F.lit(1).cast("bigint").alias("n"))


def unused_headers(layouts: DataFrame, cols: DataFrame) -> DataFrame:
    """An issue for each header that no column of the spec reads."""
    heads = layouts.select("file", "sheet", F.posexplode("headers").alias("col", "column"))
    left = heads.join(cols.select("file", "sheet", "col"), ["file", "sheet", "col"], "left_anti")
    return left.select("file", "sheet", F.lit("warning").alias("level"), F.lit("unused_headers").alias("code"), "column", F.lit(1).cast("bigint").alias("n"))


def assumed_units(cells: DataFrame, cols: DataFrame, spec: TableSpec) -> DataFrame:
    """An issue for each number column whose unit stands in the spec alone: neither in the header nor at any value."""
    named = F.regexp_extract("header", "[(（\\[［]([^()（）\\[\\]［］]{1,8})[)）\\]］]$", 1)
    bare = cols.where((F.col("type") == "number") & (F.coalesce("unit", F.lit("")) != "") & (named == "")).select("file", "sheet", "key")
    own = cells.where("starts").join(bare, ["file", "sheet", "key"], "left_semi").groupBy("file", "sheet", F.col("key").alias("column"))
    written = vl.number_unit("text") != ""
    found = own.agg(F.count_if(written).alias("written"), F.count_if(tx.trim_spaces("text") != "").alias("n")).where("written = 0 AND n > 0")
    return found.select("file", "sheet", F.lit("warning").alias("level"), F.lit("unit_assumed").alias("code"), "column", "n")


def reconcile_subtotals(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Stated totals of number columns on subtotal rows, beside the sum since the last subtotal and the grand sum."""
    cells = rows.where(F.col("row_kind").isin("data", "subtotal")).select("file", "sheet", "row_index", "row_kind", F.posexplode("cells").alias("col", "cell"))
    cells = cells.join(cols.where("type = 'number'").select("file", "sheet", "col", "key"), ["file", "sheet", "col"])
    w = W.partitionBy("file", "sheet", "col").orderBy("row_index")
    value, own = vl.parse_number(F.col("cell.text")), F.col("row_kind") == "data"
    cells = cells.withColumn("stated", value).withColumn("own", F.when(own, F.coalesce(value, F.lit(0.0))).otherwise(0.0))
    cells = cells.withColumn("island", F.coalesce(F.sum(F.when(own, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("grand_sum", F.sum("own").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    cells = cells.withColumn("running_sum", F.sum("own").over(W.partitionBy("file", "sheet", "col", "island")))
    agrees = (F.abs(F.col("stated") - F.col("running_sum")) < 1e-6) | (F.abs(F.col("stated") - F.col("grand_sum")) < 1e-6)
    return cells.where("row_kind = 'subtotal' AND stated IS NOT NULL").select("file", "sheet", "row_index", "key", "stated", "running_sum", "grand_sum", agrees.alias("agrees"))
