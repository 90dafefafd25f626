"""Column inference: dictionary match, kinds, type, role, unit and fill-down of each column of each sheet."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabletext.functions.text import value_kind
from tabletext.session import stored

SAMPLE_ROWS, RUN_ROWS = 200, 1000


@dataclass(frozen=True)
class Standard:
    key: str
    type: str
    role: str
    names: tuple[str, ...]
    unit: str = ""


# Standard columns with the names they go by; callers can give more.
STANDARDS = [
    Standard("record_no", "code", "key", ("管理no", "管理番号", "受付番号", "no", "番号", "id", "record no")),
    Standard("occurred_at", "datetime", "date", ("発生日時", "発生日", "日時", "日付", "年月日", "date", "occurred at")),
    Standard("completed_at", "datetime", "attribute", ("完了日時", "完了日", "対応完了日", "completed at")),
    Standard("equipment_id", "code", "entity", ("設備番号", "設備no", "機器番号", "equipment id")),
    Standard("equipment_name", "string", "entity_label", ("設備名", "設備名称", "機器名", "equipment")),
    Standard("symptom", "text", "text", ("現象", "症状", "不具合内容", "symptom")),
    Standard("cause", "text", "text", ("原因", "発生原因", "cause")),
    Standard("action", "text", "log", ("対応内容", "処置内容", "経過", "対応履歴", "action", "log")),
    Standard("downtime", "number", "measure", ("停止時間", "ダウンタイム", "downtime"), "分"),
    Standard("worker", "string", "person", ("担当者", "作業者", "対応者", "担当", "worker")),
    Standard("status", "status", "category", ("状態", "ステータス", "status")),
    Standard("amount", "number", "measure", ("金額", "費用", "amount"), "円"),
    Standard("note", "text", "attribute", ("備考", "特記事項", "note", "remarks")),
]
UNITS = ["分", "時間", "秒", "日", "円", "千円", "万円", "件", "個", "台", "回", "kg", "g", "m", "mm", "cm", "%", "℃"]


def norm_header(text: str) -> str:
    return re.sub(r"[\s・_\-./()（）\[\]【】:：]+", "", unicodedata.normalize("NFKC", text).lower())


def split_unit(header: str) -> tuple[str, str]:
    m = re.fullmatch(r"(.+?)[(（\[［]([^()（）\[\]［］]{1,8})[)）\]］]", header.strip())
    return (m[1].strip(), m[2]) if m and m[2] in UNITS else (header, "")


def lookup(header: str, standards: list[Standard] | None = None) -> tuple[Standard | None, str]:
    """(standard column, how): by exact name, else by the longest name inside or a close one."""
    standards = standards or STANDARDS
    name = norm_header(split_unit(header)[0])
    known = {norm_header(n): s for s in standards for n in s.names}
    if name in known:
        return known[name], "dictionary"
    inside = [n for n in known if len(n) >= 2 and n in name]
    if inside:
        return known[max(inside, key=len)], "similar"
    close = difflib.get_close_matches(name, list(known), 1, 0.8)
    return (known[close[0]], "similar") if close else (None, "")


def suggest_columns(classified: DataFrame, standards: list[Standard] | None = None) -> DataFrame:
    """(file, sheet, col, header, key, type, role, unit, fill_down, blank_rate, matched_by) from the first data rows."""
    w = W.partitionBy("file", "sheet").orderBy("row_index")
    # the first rows lie in the first runs of rows, which are found by counting
    data = classified.where("row_kind = 'data'").withColumn("run", F.floor(F.col("row_index") / RUN_ROWS))
    above = F.sum("n").over(W.partitionBy("file", "sheet").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    runs = stored(data.groupBy("file", "sheet", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.coalesce(above, F.lit(0))).where(f"above < {SAMPLE_ROWS}").select("file", "sheet", "run"))
    data = data.join(runs, ["file", "sheet", "run"]).withColumn("n", F.row_number().over(w)).where(f"n <= {SAMPLE_ROWS}")
    heads = data.select("file", "sheet", "n", F.posexplode("headers").alias("col", "header"), "cells")
    cells = heads.select("file", "sheet", "n", "col", "header", F.coalesce(F.get("cells", F.col("col"))["text"], F.lit("")).alias("text"))
    kind = value_kind("text")
    stats = cells.groupBy("file", "sheet", "col", "header").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("blank", "text", "datetime", "date", "time", "number", "code", "string")],
        F.approx_count_distinct("text").alias("values"),
        F.max(F.when(F.col("n") == 1, F.col("text") != "")).alias("first_filled"),
        F.count_if(F.regexp_count("text", F.lit("(?m)^.{0,4}[12][0-9]{3}[-/.年][0-9]{1,2}[-/.月]")) >= 2).alias("n_log"),
    )
    out = "file string, sheet string, col int, header string, key string, type string, role string, unit string, fill_down boolean, blank_rate double, matched_by string"

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                filled = r["rows"] - r["n_blank"]
                share = lambda k, r=r, n=filled: r[f"n_{k}"] / n if n else 0.0
                std, how = lookup(r["header"], standards)
                if share("text") >= 0.2:
                    kind_ = "text"
                elif share("datetime") >= 0.2:
                    kind_ = "datetime"
                elif share("date") >= 0.5:
                    kind_ = "date"
                elif share("number") >= 0.5 and share("code") < 0.2:
                    kind_ = "number"
                elif share("code") >= 0.5:
                    kind_ = "code"
                elif filled >= 20 and r["values"] <= 12 and r["values"] <= 0.2 * filled:
                    kind_ = "enum"
                else:
                    kind_ = "string"
                role = "log" if r["n_log"] >= max(2, 0.3 * filled) else std.role if std else "date" if kind_ in ("date", "datetime") else "attribute"
                kind_ = std.type if std and how == "dictionary" else kind_
                unit = split_unit(r["header"])[1] or (std.unit if std and kind_ == "number" else "")
                blank = r["n_blank"] / r["rows"] if r["rows"] else 1.0
                fill = role in ("entity", "entity_label", "category", "date") and 0.2 <= blank <= 0.9 and bool(r["first_filled"])
                rows.append((r["file"], r["sheet"], r["col"], r["header"], std.key if std else norm_header(r["header"]), kind_, role, unit, fill, round(blank, 3), how))
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in out.split(",")])

    found = stats.mapInPandas(decide, out)
    turn = F.row_number().over(W.partitionBy("file", "sheet", "key").orderBy("col"))
    return found.withColumn("key", F.when(turn == 1, F.col("key")).otherwise(F.concat("key", F.lit("_"), turn.cast("string"))))
