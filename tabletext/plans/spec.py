"""Import settings: which columns are read, as what, and what is checked; canonical JSON and hash; resolution to headers."""

from __future__ import annotations

import hashlib
import re
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletext.functions.text import nfkc
from tabletext.operators.columns import norm_header, split_unit
from tabletext.operators.enrich import stable_json

# Fixed values.
TYPES = ["code", "string", "text", "date", "datetime", "time", "number", "enum", "status"]
ROLES = ["key", "date", "entity", "entity_label", "category", "measure", "text", "log", "person", "attribute"]
OUTPUTS = ["body", "attribute", "omit"]
KEY = re.compile(r"[a-z][a-z0-9_]{0,39}")


@dataclass
class ColumnSpec:
    header: str
    key: str
    type: str = "string"
    role: str = "attribute"
    unit: str = ""
    output: str = "body"
    fill_down: bool = False
    required: bool = False
    allowed: list[str] = field(default_factory=list)
    value_map: dict[str, str] = field(default_factory=dict)


@dataclass
class TableSpec:
    name: str
    columns: list[ColumnSpec]
    group: list[str] = field(default_factory=list)
    fiscal_year: int | None = None
    year: int | None = None

    def json(self) -> str:
        return stable_json(asdict(self))

    def hash(self) -> str:
        return hashlib.sha256(self.json().encode()).hexdigest()

    @classmethod
    def load(cls, data: dict) -> TableSpec:
        """From parsed JSON; unknown names are dropped."""
        pick = lambda c, d: {f.name: d[f.name] for f in fields(c) if f.name in d}
        return cls(**pick(cls, data) | {"columns": [ColumnSpec(**pick(ColumnSpec, c)) for c in data.get("columns", [])]})


def validate(spec: TableSpec) -> list[str]:
    """What is wrong with a spec, one sentence each."""
    out = []
    keys = [c.key for c in spec.columns]
    if not spec.columns:
        out.append("no columns")
    out += [f"key {k} is used twice" for k in sorted({k for k in keys if keys.count(k) > 1})]
    for c in spec.columns:
        if not KEY.fullmatch(c.key):
            out.append(f"key {c.key!r} is not a name")
        if c.type not in TYPES:
            out.append(f"{c.key}: unknown type {c.type}")
        if c.role not in ROLES:
            out.append(f"{c.key}: unknown role {c.role}")
        if c.output not in OUTPUTS:
            out.append(f"{c.key}: unknown output {c.output}")
        if c.unit and c.type != "number":
            out.append(f"{c.key}: only numbers have units")
        if c.role == "date" and c.type not in ("date", "datetime"):
            out.append(f"{c.key}: a date role needs a date type")
    for role in ("key", "entity", "entity_label", "log"):
        if sum(c.role == role for c in spec.columns) > 1:
            out.append(f"role {role} is used twice")
    out += [f"group column {g} is not read" for g in spec.group if g not in keys]
    if len(spec.group) > 3:
        out.append("at most three group columns")
    return out


def from_suggestions(name: str, suggested: list[dict]) -> TableSpec:
    """Default settings from rows of ``suggest_columns``: one column a role, months of the date column as groups."""
    columns, roles = [], set()
    for s in sorted(suggested, key=lambda s: s["col"]):
        role = s["role"]
        if role in ("key", "date", "entity", "entity_label", "log"):
            role = "attribute" if role in roles else role
            roles.add(role)
        key = re.sub(r"[^a-z0-9_]+", "_", s["key"].lower()).strip("_")
        key = key if KEY.fullmatch(key) else f"column_{s['col'] + 1}"
        columns.append(ColumnSpec(s["header"], key, s["type"], role, s["unit"] or "", fill_down=bool(s["fill_down"])))
    return TableSpec(name, columns, [c.key for c in columns if c.role == "date"][:1])


def resolve(spec: TableSpec, headers: list[str]) -> dict[str, int]:
    """Position of each column: equal headers first, then equal but for units and upper levels; each position once."""
    used: set[int] = set()
    out: dict[str, int] = {}
    forms = [lambda h: {norm_header(h)}, lambda h: {norm_header(split_unit(h)[0]), norm_header(h.rsplit("_", 1)[-1]), norm_header(split_unit(h.rsplit("_", 1)[-1])[0])}]
    for form in forms:
        for c in spec.columns:
            if c.key in out:
                continue
            for i, h in enumerate(headers):
                if i not in used and form(c.header) & form(h):
                    out[c.key] = i
                    used.add(i)
                    break
    return out


def columns_of(spark: SparkSession, spec: TableSpec, layouts: DataFrame) -> DataFrame:
    """Columns of every sheet by the spec, in the form of ``suggest_columns``; a header is matched with and without its unit."""
    rows = [(norm_header(c.header), norm_header(split_unit(c.header)[0]), c.key, c.type, c.role, c.unit, c.fill_down, i) for i, c in enumerate(spec.columns)]
    known = spark.createDataFrame(rows, "full string, bare string, key string, type string, role string, unit string, fill_down boolean, place int")
    heads = layouts.select("file", "sheet", F.posexplode("headers").alias("col", "header"))
    strip = "[\\s・_\\-./()（）\\[\\]【】:：]+"
    bare = F.regexp_replace(F.col("header"), "[(（\\[［][^()（）\\[\\]［］]{1,8}[)）\\]］]$", "")
    norm = lambda c: F.regexp_replace(F.lower(nfkc(c)), strip, "")
    heads = heads.withColumn("h_full", norm(F.col("header"))).withColumn("h_bare", norm(bare))
    # the spec has as many rows as a sheet has columns, at most 2,000
    hit = heads.join(F.broadcast(known), (F.col("h_full") == F.col("full")) | (F.col("h_bare") == F.col("bare")))
    exact = F.col("h_full") == F.col("full")
    best = hit.groupBy("file", "sheet", "key").agg(F.min_by(F.struct("col", "header", "type", "role", "unit", "fill_down"), F.struct(~exact, F.col("col"))).alias("s"))
    return best.select(
        "file", "sheet", "s.col", "s.header", "key", "s.type", "s.role", "s.unit", "s.fill_down", F.lit(0.0).alias("blank_rate"), F.lit("spec").alias("matched_by")
    )


def apply_values(records: DataFrame, spec: TableSpec) -> DataFrame:
    """Value maps put in, omitted columns taken out."""
    values = F.col("values")

    def mapped(values: Column, column: ColumnSpec) -> Column:
        table = F.create_map(*[F.lit(x) for kv in sorted(column.value_map.items()) for x in kv])
        return F.transform_values(values, lambda k, v: F.when(k == column.key, F.coalesce(F.element_at(table, v), v)).otherwise(v))

    for c in spec.columns:
        if c.value_map:
            values = mapped(values, c)
    gone = [c.key for c in spec.columns if c.output == "omit"]
    return records.withColumn("values", F.map_filter(values, lambda k, v: ~k.isin(gone)) if gone else values)


def spec_issues(records: DataFrame, columns: DataFrame, spec: TableSpec, long_title: int = 60) -> DataFrame:
    """(file, sheet, level, code, column, n): empty required values, values not allowed, missing columns, long titles, odd years."""
    out = None

    def add(df: DataFrame, level: str, code: str, column: str | None) -> None:
        nonlocal out
        found = df.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("n")).select(
            "file", "sheet", F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(column).cast("string").alias("column"), "n"
        )
        out = found if out is None else out.unionByName(found)

    sheets = columns.select("file", "sheet").distinct()
    for c in spec.columns:
        value = F.coalesce(F.element_at("values", c.key), F.lit(""))
        absent = sheets.join(columns.where(F.col("key") == c.key).select("file", "sheet"), ["file", "sheet"], "left_anti")
        add(absent, "warning", "column_missing", c.key)
        if c.required:
            add(absent, "error", "required_missing", c.key)
            add(records.where(value == ""), "warning", "required_empty", c.key)
        if c.allowed:
            add(records.where((value != "") & ~value.isin(c.allowed)), "warning", "not_allowed", c.key)
        if c.role in ("key", "entity", "entity_label"):
            add(records.where(F.length(value) > long_title), "warning", "long_title_value", c.key)
    year = F.substring("date_value", 1, 4).try_cast("int")
    years = records.select("file", year.alias("y")).where("y IS NOT NULL").groupBy("file").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)").alias("middle"), F.count(F.lit(1)).alias("n_dated"))
    add(records.join(years, "file").where((F.col("n_dated") >= 3) & (F.abs(year - F.col("middle")) > 5)), "warning", "date_outlier", None)
    return out
