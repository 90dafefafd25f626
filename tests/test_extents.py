"""Several tables in one sheet, tables without headers, headers of two rows."""

import csv
import io

import pytest

from tabletext.operators import extents, layout
from tabletext.plans.import_plan import read_records


def rows_of(text):
    return [(i, list(r)) for i, r in enumerate(csv.reader(io.StringIO(text)), 1)]


FIRST = "管理No,発生日,設備,停止時間(分)\n" + "".join(f"K-{i},2026/4/{i},ポンプ{i},{i * 5}\n" for i in range(1, 9))
SECOND = "部品番号,部品名,数量\n" + "".join(f"P-{i},弁{i},{i}\n" for i in range(1, 6))


def imported(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    got = read_records(spark, str(tmp_path), fiscal_year=2026)
    out = {}
    for r in got.records.orderBy("sheet", "record_row").collect():
        out.setdefault(r["sheet"], []).append((r["record_row"], {k: v for k, v in r["values"].items() if v}))
    return out, got


def test_one_table_below_another(spark, tmp_path):
    text = FIRST + "\n部品表\n" + SECOND
    out, _ = imported(spark, tmp_path, text)
    assert set(out) == {"", "［2］"} and len(out[""]) == 8 and len(out["［2］"]) == 5
    assert [r for r, _ in out["［2］"]] == [13, 14, 15, 16, 17]  # rows of the sheet
    assert sorted(out["［2］"][0][1].values()) == ["1", "P-1", "弁1"]


def test_one_table_beside_another(spark, tmp_path):
    left, right = FIRST.split("\n"), SECOND.split("\n")
    text = "\n".join(f"{a or ',,,'},,{b or ',,'}" for a, b in zip(left, [*right, "", "", ""], strict=False) if a)
    out, _ = imported(spark, tmp_path, text)
    assert len(out[""]) == 8 and len(out["［2］"]) == 5
    assert sorted(out["［2］"][4][1].values()) == ["5", "P-5", "弁5"] and "部品番号" not in str(out[""])


def test_blank_rows_and_continuations_do_not_cut(spark, tmp_path):
    text = FIRST + "\n" + "".join(f"K-{i},2026/5/{i},送風機{i},{i * 5}\n" for i in range(11, 15)) + "\n※ 注記\n"
    out, _ = imported(spark, tmp_path, text)
    assert set(out) == {""} and len(out[""]) == 12


def test_column_spans():
    rows = [t for _, t in rows_of(FIRST)]
    assert extents.column_spans(rows, 0) == [(0, 4)]
    gap = [[*r[:2], "", *r[2:]] for r in rows]
    assert extents.column_spans(gap, 0) == [(0, 2), (3, 5)]
    filled = [gap[0], *[[*r[:2], "x", *r[3:]] for r in gap[1:]]]
    assert extents.column_spans(filled, 0) == [(0, 5)]  # values under a blank header
    far = [[*rows[0], *[""] * 30, "メモ"], *rows[1:]]
    assert extents.column_spans(far, 0) == [(0, 4)]
    wide = [rows[0], *[[*r, "続き"] for r in rows[1:]]]
    assert extents.column_spans(wide, 0) == [(0, 5)]
    assert extents.column_spans([], 0) == [(0, 0)] and extents.column_spans([["", ""]], 0) == [(0, 2)]


@pytest.mark.parametrize(
    ("row", "reason"),
    [(["K-0", "2026/4/1", "ポンプ0", "5"], "date"), (["K-0", "x", "ポンプ0", "5"], ""), (["管理No", "発生日", "設備", "停止時間(分)"], ""), (["K-0"], "")],
)
def test_headers_that_are_data(row, reason):
    below = [t for _, t in rows_of(FIRST)][1:]
    assert layout.looks_like_data(row, below) == reason


def test_headerless_table(spark, tmp_path):
    out, got = imported(spark, tmp_path, FIRST.split("\n", 1)[1])
    assert len(out[""]) == 8 and out[""][0][0] == 1
    assert got.rows.select("header_reason").first()["header_reason"] == "date"


def test_units_below_headers_and_codes():
    rows = rows_of("品名,数量,重さ\n,(個),(kg)\n" + "".join(f"弁{i},{i},{i}.5\n" for i in range(1, 9)))
    found = layout.guess(rows)
    assert found["headers"] == ["品名", "数量(個)", "重さ(kg)"] and found["header_rows"] == [1, 2] and found["data_start"] == 3
    codes = rows_of("".join(f"AB-{i},X{i}9,弁{i}\n" for i in range(1, 9)))
    assert layout.guess(codes)["header_reason"] in ("code", "same") and layout.guess(codes)["data_start"] == 1
