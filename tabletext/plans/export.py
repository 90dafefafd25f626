"""Records to Markdown files, and the sinks: partitioned text, JSON lines, issues as CSV, a deterministic zip."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions import text as tx
from tabletext.functions.titles import record_title
from tabletext.operators import documents
from tabletext.plans import rendering
from tabletext.plans.spec import TableSpec


def record_blocks(records: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Adds ``block``: a title, a bullet for each value in key order, and the source line."""
    shown = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    label = lambda k: F.coalesce(F.element_at(shown, k), k)
    pairs = F.array_sort(F.map_entries("values"))
    bullets = F.transform(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""), lambda p: tx.md_bullet(label(p["key"]), p["value"]))
    title = F.concat(F.lit("## "), record_title("record_key", F.lit(""), F.lit(""), F.lit(""), "date_value"))
    source = F.concat(F.lit("- 出典: "), F.element_at(F.split("file", "/"), -1), F.when(F.col("sheet") != "", F.concat(F.lit("・"), "sheet")).otherwise(F.lit("")), F.lit(" "), F.col("record_row").cast("string"), F.lit("行目"))
    return records.withColumn("block", F.concat(title, F.lit("\n\n"), F.array_join(F.concat(bullets, F.array(source)), "\n")))


def render(
    records: DataFrame, group: Column | None = None, limit: int = documents.FILE_CHARS, names: dict[str, str] | None = None, table: str | None = None,
    spec: TableSpec | None = None, people: DataFrame | None = None,
) -> DataFrame:
    """(file_name, text, n_records): a file for each month (or other group), cut by size, with unique names.

    With the name of the ``table``, files start with the full head of ``documents.file_headers``, else with group and count.
    With a ``spec``, records are rendered in its order, those over the token budget in parts.
    """
    if group is None and spec is not None and spec.group:
        group = rendering.group_name(spec)
    month = F.coalesce(F.substring("date_value", 1, 7), F.lit("日付なし")) if group is None else group
    blocks = record_blocks(records, names) if spec is None else rendering.spec_blocks(records, spec, people)
    blocks = blocks.withColumn("file_group", month)
    order = [*documents.dated_first("date_value", "file", "sheet", "record_row", "record_key")]
    files = documents.file_groups(blocks, ["file_group"], order, "block", limit)
    number = F.concat(F.lpad(F.col("part").cast("string"), F.length(F.col("parts").cast("string")), "0"), F.lit("of"), F.col("parts").cast("string"))
    name = tx.md_filename(tx.safe_file_part("file_group"), F.when(F.col("parts") > 1, number).otherwise(F.lit("")))
    named = documents.unique_names(files.withColumn("name", name), "name", ["file_group", "part"], "file_name")
    if table is None:
        named = named.withColumn("header", F.concat(F.lit("# "), "file_group", F.lit("\n\n- 件数: "), F.col("n_records").cast("string")))
    else:
        named = documents.file_headers(named, table, "file_group", "file_name")
    head = F.concat("header", F.lit("\n\n"))
    return named.select("file_name", F.concat(head, "text", F.lit("\n")).alias("text"), "n_records")


def write_records(records: DataFrame, path: str) -> None:
    """Records as gzip JSON lines, in order within files that do not overlap."""
    records.repartitionByRange("file", "sheet", "record_row").sortWithinPartitions("file", "sheet", "record_row").write.mode("overwrite").option("compression", "gzip").json(path)


def write_files(files: DataFrame, path: str) -> None:
    """Files as a table (file_name, text), for any number of files."""
    files.write.mode("overwrite").parquet(path)


def zip_bytes(files: DataFrame, limit_bytes: int = 400 << 20) -> bytes:
    """One flat zip with sorted names and a fixed time, for a batch of at most ``limit_bytes`` characters."""
    size = files.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > limit_bytes:
        raise ValueError(f"{size} characters; write_files takes any number")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.orderBy("file_name").toLocalIterator():
            info = zipfile.ZipInfo(r["file_name"], (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, r["text"])
    return out.getvalue()


def issues_csv(issues: DataFrame, top: int = 10_000) -> bytes:
    """The first issues as CSV with a BOM, errors first, formulas guarded; a last row says how many were left out. ``write_issues`` writes all."""
    left_out = issues.count() - top
    guarded = issues.orderBy(F.col("level") != "error", "file", "sheet", "code", "column").limit(top)
    guarded = guarded.select(*[tx.guard_formula(F.col(c).cast("string")).alias(c) if t == "string" else c for c, t in issues.dtypes])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(issues.columns)
    writer.writerows(guarded.collect())
    if left_out > 0:
        texts = {"level": "info", "code": "issues_truncated", "message": f"{left_out} more"}
        writer.writerow([texts.get(c, "") for c in issues.columns])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def write_issues(issues: DataFrame, path: str) -> None:
    """All issues as CSV files, written by Spark, formulas guarded."""
    guarded = issues.select(*[tx.guard_formula(F.col(c).cast("string")).alias(c) if t == "string" else F.col(c) for c, t in issues.dtypes])
    guarded.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
