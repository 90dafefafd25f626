"""Records to text in the order of a spec: title, bullets, the log, the source, and parts within the token budget.

Every value is a Column expression over the map of a record's values; only logs with people and records over the budget
come to Python workers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletext.functions import text as tx
from tabletext.functions.titles import clip_title, record_title
from tabletext.operators import documents, incidents, logs, record_parts
from tabletext.operators.columns import split_unit
from tabletext.plans.spec import ColumnSpec, TableSpec

# Words that end the name of a column of numbers of things, and how units are written.
NUMBER_WORDS = "(?:番号|ナンバー|コード|ID|Id|id|No\\.?|NO\\.?|no\\.?)$"
UNIT_LABELS = {"h": "時間", "H": "時間", "hr": "時間", "min": "分"}
NAME_CHARS, TEXT_CHARS, PIECE_CHARS = 60, 40, 20


def shown_name(c: ColumnSpec) -> str:
    """The header of a column without its unit."""
    bare = re.sub(f"\\s*[(（\\[［]{re.escape(c.unit)}[)）\\]］]$", "", c.header) if c.unit else c.header
    return split_unit(bare)[0]


def _first(spec: TableSpec, role: str) -> ColumnSpec | None:
    return next((c for c in spec.columns if c.role == role), None)


def value_of(c: ColumnSpec | None) -> Column:
    """The value of a column as it stands, empty if there is none."""
    return F.lit("") if c is None else F.coalesce(F.element_at("values", c.key), F.lit(""))


def formatted(c: ColumnSpec) -> Column:
    """A number with its unit, other values as they are."""
    v = value_of(c)
    if c.type != "number" or not c.unit:
        return v
    return F.when(v.try_cast("double").isNotNull(), F.concat(v, F.lit(UNIT_LABELS.get(c.unit, c.unit)))).otherwise(v)


def date_text(date: Column, time: Column | None = None) -> Column:
    """A day with its time, and the month it lies in spelled out."""
    whole = date if time is None else F.when((time != "") & (F.length(date) == 10), F.concat_ws(" ", date, time)).otherwise(date)
    month = F.concat(F.lit("（"), documents.month_label(date), F.lit("）"))
    return F.when(date.rlike("^(?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])"), F.concat(whole, month)).otherwise(whole)


def entity_parts(spec: TableSpec) -> Column:
    """Struct (code, name, shown) of what a record is about: ``name（code）``, from two columns or one that holds both."""
    entity, label = _first(spec, "entity"), _first(spec, "entity_label")
    if entity is None or label is not None:
        parts = F.struct(value_of(entity).alias("code"), value_of(label).alias("name"))
    else:
        parts = tx.split_entity_code(value_of(entity))

    def shown(p: Column) -> Column:
        both = (p["code"] != "") & (p["name"] != "") & (p["code"] != p["name"])
        return F.struct(p["code"].alias("code"), p["name"].alias("name"), F.when(both, F.concat(p["name"], F.lit("（"), p["code"], F.lit("）"))).when(p["code"] != "", p["code"]).otherwise(p["name"]).alias("shown"))

    return tx.let(parts, shown)


def time_column(spec: TableSpec) -> ColumnSpec | None:
    """The column of times that belongs to the date column: ``x_time`` beside ``x_date`` or ``x_at``."""
    date = _first(spec, "date")
    stem = re.sub("_(?:at|date)$", "", date.key) if date else ""
    return next((c for c in spec.columns if c.type == "time" and c.key in (f"{stem}_time", "occurred_time")), None) if date else None


def spec_title(spec: TableSpec) -> Column:
    """``【key】name（code）text｜date``; where all but the date are blank, the first three values; else the row."""
    text = _first(spec, "text") or next((c for c in spec.columns if c.key == "symptom"), None)
    date = F.substring(F.coalesce("date_value", F.lit("")), 1, 10)
    shown = [c for c in spec.columns if c.output != "omit"]
    fallback = F.array(*[clip_title(tx.one_line(value_of(c)), PIECE_CHARS) for c in shown if c.type != "text" and c.role not in ("date", "log")] or [F.lit("")])
    fallback = F.array_join(F.slice(F.filter(fallback, lambda x: x != ""), 1, 3), " ")
    plain = record_title(tx.one_line(value_of(_first(spec, "key"))), clip_title(entity_parts(spec)["shown"], NAME_CHARS), F.lit(""), value_of(text), F.lit(""))
    row = F.concat(F.col("record_row").cast("string"), F.lit("行目の記録"))

    def whole(head: Column) -> Column:
        dated = F.when(date != "", F.concat(head, F.when(head != "", "｜").otherwise(""), date)).otherwise(head)
        return tx.let(dated, lambda t: F.when(t == "", row).otherwise(t))

    return tx.let(plain, lambda p: whole(F.when(p == "", fallback).otherwise(p)))


def bullets_of(spec: TableSpec) -> tuple[list[tuple[ColumnSpec, Column]], list[ColumnSpec]]:
    """(column, bullet) in the order of the spec, and the columns that every part of a record repeats: key, entity and date."""
    entity, label, date, time = _first(spec, "entity"), _first(spec, "entity_label"), _first(spec, "date"), time_column(spec)
    about = [c for c in (entity, label) if c is not None]
    merged = len(about) == 2 and all(c.output != "omit" for c in about)
    out = []
    for c in spec.columns:
        if c.output == "omit" or c.role == "log":
            continue
        name = F.lit(shown_name(c))
        if merged and c in about:
            both = entity_parts(spec)
            stem = re.sub(NUMBER_WORDS, "", shown_name(entity)).strip() or shown_name(entity)
            joined = (both["code"] != "") & (both["name"] != "")
            first = next(x for x in spec.columns if x in about)
            alone = tx.md_bullet(name, formatted(c))
            bullet = F.when(joined, tx.md_bullet(F.lit(stem), both["shown"]) if c is first else F.lit("")).otherwise(alone)
        elif c is entity:
            bullet = tx.md_bullet(name, entity_parts(spec)["shown"])
        elif c is date:
            bullet = tx.md_bullet(name, date_text(value_of(c), None if time is None else value_of(time)))
        elif c is time:
            bullet = F.when(value_of(date) == "", tx.md_bullet(name, value_of(c))).otherwise("")
        else:
            bullet = tx.md_bullet(name, formatted(c))
        out.append((c, bullet))
    return out, [c for c in (_first(spec, "key"), *about, date) if c is not None]


def source_line(spec: TableSpec) -> Column:
    """``- 出典: file（key・シート「」N行目）``."""
    key = _first(spec, "key")
    name = F.element_at(F.split("file", "/"), -1)
    place = F.concat(F.when(F.coalesce("sheet", F.lit("")) != "", F.concat(F.lit("シート「"), "sheet", F.lit("」"))).otherwise(F.lit("")), F.col("record_row").cast("string"), F.lit("行目"))
    stated = F.when(value_of(key) != "", F.concat(F.lit(f"{shown_name(key)} " if key else ""), tx.one_line(value_of(key))))
    return F.concat(F.lit("- 出典: "), name, F.lit("（"), F.concat_ws("・", stated, place), F.lit("）"))


def group_columns(spec: TableSpec) -> list[ColumnSpec]:
    """The columns that files are grouped by: in the order of the table, days last."""
    chosen = [c for c in spec.columns if c.key in spec.group]
    return sorted(chosen, key=lambda c: c.type in ("date", "datetime"))


def group_value(spec: TableSpec, c: ColumnSpec) -> Column:
    """The group of a record by one column: the month of a day, the number of an entity, else the value on one line."""
    if c.type in ("date", "datetime") or c.role == "date":
        return F.when(value_of(c).rlike("^(?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])"), F.substring(value_of(c), 1, 7)).otherwise("")
    return entity_parts(spec)["code"] if c.role == "entity" else tx.one_line(value_of(c))


def group_name(spec: TableSpec) -> Column:
    """The groups of a record joined, those without a value named so."""

    def named(c: ColumnSpec) -> Column:
        none = "日付なし" if c.type in ("date", "datetime") else f"{shown_name(c)}なし"
        return tx.let(group_value(spec, c), lambda v: F.when(v == "", none).otherwise(clip_title(v, NAME_CHARS)))

    parts = [named(c) for c in group_columns(spec)]
    return F.concat_ws("_", *parts) if parts else F.lit("")


def group_order(spec: TableSpec) -> list[Column]:
    """Order of the files: by each column of groups, those without a value last."""
    return [part for c in group_columns(spec) for part in (group_value(spec, c) == "", group_value(spec, c))]


def rendered(records: DataFrame, spec: TableSpec, people: DataFrame | None = None, budget: int = documents.BLOCK_TOKENS, points: str | None = None) -> DataFrame:
    """Adds ``title``, ``body`` and ``repeats`` (lines), and ``lines``: the lines of the record's parts, each within the budget.

    A log column becomes its timeline, with authors by the index ``people``; undated logs take the record's date. Titles that
    several records of a file share get the row. ``points`` names a column of ``incidents.check_incident``, written before the log.
    """
    bullets, again = bullets_of(spec)
    log = _first(spec, "log")
    nothing = F.array().cast("array<string>")
    lines = lambda bullet: F.filter(F.split(bullet, "\n"), lambda x: x != "")
    out = records
    own = [F.transform(F.array(bullet), lines)[0] for _, bullet in bullets]
    if points is not None:
        said = incidents.point_lines(points)
        own.append(tx.let(said, lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit("- 対応の要点（AI抽出）:")), F.transform(x, lambda y: F.concat(F.lit("  "), tx.escape_md_line(y))))).otherwise(nothing)))
    if log is not None and log.output != "omit":
        dated = out.withColumn("log_text", value_of(log)).withColumn("log_day", F.substring(F.coalesce("date_value", F.lit("")), 1, 10).try_cast("date").cast("string"))
        out = logs.parse_log(dated, "log_text", "log_day", people=people)
        line = logs.timeline()
        own.append(F.when((F.col("log.kind") != "empty") & (line != ""), F.concat(F.array(F.lit("- 対応の時系列:")), F.transform(F.split(line, "\n"), lambda x: F.concat(F.lit("  "), x)))).otherwise(F.array().cast("array<string>")))
    own.append(F.array(source_line(spec)))
    out = out.withColumn("title", F.concat(F.lit("## "), spec_title(spec))).withColumn("body", F.flatten(F.array(*own)))
    repeats = [F.transform(F.array(bullet), lines)[0] for c, bullet in bullets if c in again]
    out = out.withColumn("repeats", F.flatten(F.array(*repeats)) if repeats else F.array().cast("array<string>"))
    out = documents.title_suffixes(out, "title", ["file", "sheet"], "record_row")
    return record_parts.split_records(out, "title", "body", "repeats", budget).drop("log", "log_text", "log_day")


def spec_blocks(records: DataFrame, spec: TableSpec, people: DataFrame | None = None, budget: int = documents.BLOCK_TOKENS) -> DataFrame:
    """The records with ``block``: their parts, a blank line between."""
    return rendered(records, spec, people, budget).withColumn("block", F.array_join(record_parts.part_texts("lines"), "\n\n"))
