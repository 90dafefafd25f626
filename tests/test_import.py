"""Files to records to documents, end to end."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tabletext.operators import columns, layout, logs
from tabletext.plans import export, file_queries, import_plan, spec
from tabletext.plans.import_plan import read_records
from tabletext.sources import encodings, workbook
from tabletext.sources.files import read_files, sniff_files
from tabletext.streaming.ingest import taken, watch

HEADER = "管理No,発生日時,設備番号,設備名,現象,停止時間(分),担当者"


def table_csv(n=30):
    rows = [f"K-{i:03d},2026/{4 + i // 10}/{i % 10 + 1} 10:0{i % 10},EQ-{i % 4:02d},ポンプ{i % 4},異音が発生した{i},{i * 5},担当{i % 3}" for i in range(n)]
    return "\n".join([HEADER, *rows]) + "\n"


def test_ladder_of_encodings():
    """Lines of two encodings in one file, characters of the vendors' table, half-width kana, and switches of character sets."""
    shifted = "管理No,内容\r\n1,髙﨑さん\r\n".encode("cp932")
    assert encodings.detect_encoding(shifted)[0] == "cp932"
    assert encodings.detect_encoding(shifted + b"2,\x81\n")[0::2] == ("cp932", 3)
    assert encodings.decode(shifted + b"2,\x81\n", "cp932", strict=False).endswith("2,〓\n")
    mixed = shifted + "2,日本語\r\n".encode()
    name = encodings.detect_encoding(mixed)[0]
    text = encodings.decode(mixed, name, strict=False)
    assert name == "cp932" and text.replace(encodings.MIXED, "") == "管理No,内容\r\n1,髙﨑さん\r\n2,日本語\r\n" and text.count(encodings.MIXED) == 1
    assert encodings.detect_encoding("ﾎﾟﾝﾌﾟ,ﾃｽﾄ\n".encode("cp932"))[0] == "cp932"
    assert encodings.detect_encoding("これはひらがなの文です\n".encode("euc_jp"))[0] == "euc_jp"
    assert encodings.detect_encoding("丂,鷗\n".encode("iso2022_jp_ext"))[0] == "iso2022_jp_ext"
    assert encodings.detect_encoding("a,b\n1,漢\n".encode("utf-16-be"))[0] == "utf-16-be"
    long = ("1,あ\n" * 400_000).encode("cp932")
    assert encodings.sniff(long, "x.csv").encoding == "cp932" and len(encodings.part(long, "cp932")) < encodings.HEAD_BYTES


def test_compatibility_forms_and_sheets_without_days(spark, tmp_path):
    lines = "管理No,設備名,停止時間(分)\n" + "".join(f"ＡＢ－{i},ﾎﾟﾝﾌﾟ㈱½①,１{i}\n" for i in range(1, 9))
    (tmp_path / "a.csv").write_text(lines, encoding="utf-8")
    got = read_records(spark, str(tmp_path))
    row = got.records.orderBy("record_row").first()
    assert row["record_key"] == "AB-1" and set(row["values"].values()) == {"AB-1", "ポンプ(株)1⁄2①", "11"}
    assert ("no_date_column", 1) in {(r["code"], r["n"]) for r in got.issues.collect()}


def test_mixed_lines_are_noted(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("No,内容\n1,漢字\n".encode("cp932") + "2,日本\n".encode())
    rows = {r["row_index"]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert [c["text"] for c in rows[3]["cells"]] == ["2", "日本"] and rows[3]["notes"] == ["mixed_encoding"] and not rows[2]["notes"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp932", "euc_jp", "iso2022_jp", "utf-16"])
def test_sniff_encodings(encoding):
    """Whole files in one encoding."""
    d = encodings.sniff(table_csv().encode(encoding), "x.csv")
    assert encodings.decode(table_csv().encode(encoding), d.encoding) == table_csv()
    assert (d.delimiter, d.header_record, d.columns) == (",", 0, 7)


def test_sniff_limits(spark, tmp_path):
    for data in (b"", b"PK\x03\x04xxxx", bytes(range(1, 9)) * 50):
        with pytest.raises(encodings.SourceError):
            encodings.sniff(data)
    text = "表題\n作成 2026\n\na;b;c\n1;x;y\n2;x;y\n3;x;y\n合計;6;\n"
    d = encodings.sniff(text.encode(), "a.csv")
    assert d.delimiter == ";" and d.header_record == 3 and d.trailer_records in (0, 1)
    assert encodings.decode(b"a\xff", "utf-8", strict=False) == "a〓"
    (tmp_path / "a.csv").write_text(table_csv())
    (tmp_path / "b.csv").write_bytes(b"PK\x03\x04")
    rows = {r["file"].rsplit("/", 1)[-1]: r for r in sniff_files(spark, str(tmp_path)).collect()}
    assert rows["a.csv"]["columns"] == 7 and rows["b.csv"]["error"]


def test_notes_of_records():
    notes = lambda t: [n for _, n in encodings.noted_records(t, ",")]
    assert notes("a,b\n1,2\n") == [[], []] and notes("") == []
    assert notes('a,b\n"1,2\n3,4') == [[], ["unclosed_quote"]]
    assert notes('a,b\n"1\n2",x"y') == [[], []] and notes('a,"b"""') == [[]]
    assert notes('"' + "x\n" * 500 + '",1\n2,3') == [["long_record"], []]


def test_csv_end_to_end(spark, tmp_path):
    (tmp_path / "list.csv").write_text(table_csv(), encoding="cp932")
    got = read_records(spark, str(tmp_path))
    assert {r["key"]: r["type"] for r in got.columns.collect()}["occurred_at"] == "datetime"
    records = {r["record_key"]: r for r in got.records.collect()}
    assert len(records) == 30
    first = records["K-000"]["values"]
    assert first["occurred_at"] == "2026-04-01 10:00" and first["downtime"] == "0" and first["equipment_name"] == "ポンプ0"
    files = export.render(got.records)
    names = sorted(r["file_name"] for r in files.collect())
    assert names == ["2026-04.md", "2026-05.md", "2026-06.md"]
    assert export.zip_bytes(files) == export.zip_bytes(export.render(got.records.repartition(5)))
    text = {r["file_name"]: r["text"] for r in files.collect()}["2026-04.md"]
    assert "## 【K-000】｜2026-04-01 10:00" in text and "- 件数: 10" in text
    export.write_records(got.records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 30
    assert [r["code"] for r in got.issues.where("level = 'error'").collect()] == []


def test_rows_to_records(spark, tmp_path):
    text = "\n".join([
        "停止記録 2026", "", HEADER,
        "K-1,2026/4/1,EQ-01,ポンプ,異音,10,田中", ",,,,続きの文,,", "K-2,4/2,〃,〃,漏れ,二十,同上", "K-2,2026/4/3,EQ-02,弁,閉,1:30,佐藤", "小計,,,,,100,", "K-4,2026/4/4,EQ-02,弁,開,15,#N/A",
        "※ 注記", "", "", "", "別表,x,,,,,",
    ])
    (tmp_path / "list.csv").write_text(text + "\n")
    got = read_records(spark, str(tmp_path))
    kinds = {r["row_index"]: r["row_kind"] for r in got.rows.collect()}
    assert kinds == {1: "title", 2: "blank", 3: "header", 4: "data", 5: "continuation", 6: "data", 7: "data", 8: "subtotal", 9: "data", 10: "note", 11: "blank", 12: "blank", 13: "blank", 14: "after"}
    records = {r["record_key"]: r for r in got.records.collect()}
    assert set(records) == {"K-1", "K-2", "K-2#2", "K-4"}
    assert records["K-1"]["values"]["symptom"] == "異音\n続きの文"
    assert records["K-2"]["values"]["equipment_id"] == "EQ-01" and records["K-2"]["values"]["worker"] == "田中"
    assert records["K-2"]["values"]["downtime"] == "二十" and records["K-2"]["values"]["occurred_at"] == "4/2"
    assert records["K-2#2"]["values"]["downtime"] == "90"
    codes = {(r["code"], r["column"]) for r in got.issues.collect()}
    assert {("type_error_rate", "downtime"), ("year_missing", "occurred_at"), ("duplicate_key", None), ("ditto_filled", "worker")} <= codes
    assert [r["agrees"] for r in got.subtotals.collect()] == [False]
    fiscal = read_records(spark, str(tmp_path), fiscal_year=2026).records.where("record_key = 'K-2'").first()
    assert fiscal["values"]["occurred_at"] == "2026-04-02"
    csv = export.issues_csv(got.issues)
    assert csv.startswith(b"\xef\xbb\xbf") and b"\r\n" in csv


def test_spec(spark, tmp_path):
    (tmp_path / "list.csv").write_text(table_csv(12))
    make = lambda: spec.TableSpec(
        "t",
        [
            spec.ColumnSpec("管理No", "no", "code", "key"), spec.ColumnSpec("発生日時", "at", "datetime", "date"), spec.ColumnSpec("設備番号", "eq", "code", "entity", value_map={"EQ-00": "A"}, allowed=["EQ-00", "EQ-01"]),
            spec.ColumnSpec("停止時間", "stop", "number", "measure", unit="分", required=True), spec.ColumnSpec("担当者", "who", output="omit"), spec.ColumnSpec("無い列", "none", required=True),
        ],
        ["at"],
    )
    s = make()
    assert spec.validate(s) == [] and spec.TableSpec.load({**__import__("json").loads(s.json()), "old": 1}).hash() == s.hash() == make().hash()
    assert spec.resolve(s, HEADER.split(","))["stop"] == 5 and "none" not in spec.resolve(s, HEADER.split(","))
    got = read_records(spark, str(tmp_path), spec=s)
    values = {r["record_key"]: r["values"] for r in got.records.collect()}
    assert values["K-000"] == {"no": "K-000", "at": "2026-04-01 10:00", "eq": "A", "stop": "0"}
    codes = {(r["code"], r["column"], r["n"]) for r in got.issues.collect()}
    assert {("column_missing", "none", 1), ("required_missing", "none", 1), ("unused_headers", "設備名", 1)} <= codes and ("not_allowed", "eq", 6) in codes
    bad = spec.TableSpec("t", [spec.ColumnSpec("a", "A b", "x", "y", "分", "z"), spec.ColumnSpec("b", "k", role="date"), spec.ColumnSpec("c", "k")], ["q"])
    assert len(spec.validate(bad)) >= 7
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path), spec=bad)
    assert spec.from_suggestions("t", [r.asDict() for r in read_records(spark, str(tmp_path)).columns.collect()]).group == ["occurred_at"]


def sheet_xlsx(rows, merges="", links="", rels="", hidden=(), date1904=False):
    """A workbook of inline cells; a row is a list of (text or number, style)."""
    body = ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, cell in enumerate(row):
            if cell is None:
                continue
            value, style = cell if isinstance(cell, tuple) else (cell, 0)
            ref = f"{chr(65 + c)}{r}"
            cells += f'<c r="{ref}" s="{style}"><v>{value}</v></c>' if isinstance(value, int | float) else f'<c r="{ref}" s="{style}" t="inlineStr"><is><t>{value}</t></is></c>'
        body += f'<row r="{r}"{" hidden=\"1\"" if r in hidden else ""}>{cells}</row>'
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    styles = '<numFmts count="1"><numFmt numFmtId="170" formatCode="[h]:mm"/></numFmts><fonts><font/><font><b/></font><font><strike/></font></fonts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="22"/><xf numFmtId="170"/><xf fontId="1"/><xf fontId="2"/><xf numFmtId="20"/></cellXfs>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="表" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main} {rel}><sheetData>{body}</sheetData>{merges}{links}</worksheet>")
        if rels:
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f"<Relationships>{rels}</Relationships>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    data = sheet_xlsx(
        [["番号", "日付", "時刻", "所要"], [("A1", 4), (46113, 1), (0.5, 6), (1.25, 3)], None or [], [("x", 5), (46113.75, 2), 12.5, 3]],
        merges='<mergeCells><mergeCell ref="A2:A3"/></mergeCells>',
        links='<hyperlinks><hyperlink ref="C4" r:id="rId9" location="p"/></hyperlinks>',
        rels='<Relationship Id="rId9" Target="http://e.com"/>',
        hidden=(4,),
    )
    (tmp_path / "a.xlsx").write_bytes(data)
    rows = read_files(spark, str(tmp_path)).orderBy("row_index").collect()
    text = lambda r: [c["text"] for c in rows[r]["cells"]]
    assert text(1) == ["A1", "2026-04-01", "12:00", "30:00"] and text(3)[1:3] == ["2026-04-01 18:00", "12.5"]
    assert rows[1]["cells"][0]["bold"] and rows[3]["cells"][0]["strike"] and rows[3]["hidden"]
    assert rows[2]["cells"][0]["anchor_row"] == 2 and rows[3]["cells"][2]["link"] == "http://e.com#p"
    assert workbook.serial_text(1.0, "yyyy/m/d", True) == ("date", "1904-01-02")
    with pytest.raises(encodings.SourceError):
        workbook.precheck(b"nothing")


def test_layout_and_columns():
    rows = [(1, ["報告", None, None]), (2, ["番号", "日付", "件数"]), *[(i, [f"A{i}", f"2026/4/{i}", str(i)]) for i in range(3, 12)]]
    found = layout.guess(rows)
    assert found["header_rows"] == [2] and found["table_kind"] == "list" and found["headers"] == ["番号", "日付", "件数"]
    two = [(1, [None, "金額", None]), (2, ["番号", "予定", "実績"]), *[(i, [f"A{i}", "1", "2"]) for i in range(3, 9)]]
    assert layout.guess(two)["headers"] == ["番号", "金額_予定", "金額_実績"]
    months = [(1, ["品名", "4月", "5月", "6月"]), *[(i, ["x", "1", "2", "3"]) for i in range(2, 9)]]
    assert layout.guess(months)["table_kind"] == "crosstab"
    assert layout.guess([(1, [None])])["table_kind"] == "unknown"
    assert columns.lookup("停止時間（分）")[0].key == "downtime" and columns.lookup("設備番号")[1] == "dictionary"
    assert columns.lookup("まったく別")[0] is None


def test_logs(spark):
    text = "・2026/4/1 10:00 田中：連絡した\n続き\n2026/4/3 交換 P-12\n9/25 はまだ"
    df = logs.parse_log(spark.createDataFrame([(1, text), (2, "なし"), (3, "9/25 交換")], "i int, t string"), "t")
    rows = {r["i"]: r["log"] for r in df.collect()}
    assert rows[1]["kind"] == "log" and rows[1]["order"] == "asc" and len(rows[1]["segments"]) == 2
    assert rows[1]["segments"][0]["author"] == "田中" and rows[1]["segments"][0]["time"] == "10:00"
    assert rows[1]["segments"][1]["identifiers"] == ["P-12"]
    assert rows[2]["kind"] == "empty" and rows[3]["kind"] == "single"
    line = df.where("i = 1").select(logs.timeline().alias("t")).first()["t"].split("\n")[0]
    assert line.startswith("1. 2026-04-01 10:00 田中: 連絡した")
    joined = df.select(F.array_join(logs.split_pieces("t"), "\n").alias("j"), "t").collect()
    assert all(r["j"] == r["t"] for r in joined)


def test_drop_folder(spark, tmp_path):
    drop, seen = tmp_path / "in", []
    drop.mkdir()
    (drop / "a.csv").write_text("x")
    run = lambda: watch(spark, str(drop), str(tmp_path / "state"), lambda df, n: seen.extend(r["path"].rsplit("/", 1)[-1] for r in df.collect())).awaitTermination()
    run()
    (drop / "b.csv").write_text("y")
    run()
    assert seen == ["a.csv", "b.csv"]
    (drop / "c.csv").write_text("x")  # the content of the first under another name, in a later batch and run
    (drop / "d.csv").write_text("z")
    (drop / "e.csv").write_text("z")
    run()
    assert seen == ["a.csv", "b.csv", "d.csv"]
    assert {(r["path"].rsplit("/", 1)[-1], r["batch"]) for r in taken(spark, f"{tmp_path / 'state'}-contents").collect()} == {("a.csv", 0), ("b.csv", 1), ("d.csv", 2)}


def test_orders_make_more_files_as_they_grow(spark, monkeypatch):
    """Files of a bounded number of rows, and no join by missing anchors where no cell is merged."""
    joined = []
    whole = import_plan.filled_members
    monkeypatch.setattr(import_plan, "filled_members", lambda cells: joined.append(1) or whole(cells))
    monkeypatch.setattr(file_queries, "FILE_ROWS", 100)
    got = file_queries.orders_as_files(spark, "/root/testdata/sf0.001")
    counts = got.records.groupBy("file").count().collect()
    assert sum(r["count"] for r in counts) == 1500 and len(counts) >= 15 and not joined


def test_plain_sheets_need_no_window(spark, monkeypatch):
    """Sheets without blank rows, continuations and ditto marks: one window, that of equal keys, and no row for each cell."""
    monkeypatch.setattr(file_queries, "FILE_ROWS", 100)
    plan = file_queries.orders_as_files(spark, "/root/testdata/sf0.001").records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Generate" not in plan and "Aggregate" not in plan


def test_plain_sheets_beside_others(spark, tmp_path):
    """A file that needs windows (blank rows, ditto marks, continuations) and one that does not, read together and alone."""
    marked = "\n".join([HEADER, *(f"M-{i},2026/4/{i},EQ-1,{'〃' if i % 2 == 0 else f'炉{i}'},故障した{i},{i},田中" + ("\n,,,,続き,," if i == 5 else "") for i in range(1, 12)), "", "N-1,2026/5/1,EQ-2,〃,止まった,3,田中"])
    for name, body in (("a", table_csv()), ("b", marked + "\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.csv").write_text(body)
    taken = lambda path: sorted((r["file"], r["record_row"], r["record_key"], r["date_value"], sorted(r["values"].items()), sorted(r["originals"].items())) for r in read_records(spark, path).records.collect())
    both = taken(f"{tmp_path}/*/*.csv")
    values = {r[2]: dict(r[4]) for r in both}
    assert len(both) == 42 and values["M-4"]["equipment_name"] == "炉3" and values["N-1"]["equipment_name"] == "炉11" and values["M-5"]["symptom"] == "故障した5\n続き"
    assert both == taken(f"{tmp_path}/a/*.csv") + taken(f"{tmp_path}/b/*.csv")


def test_values_in_plain_and_other_forms(spark):
    rows = [
        ("1,234.50", "number", "円"), ("￥1,000", "number", "円"), ("12", "number", "円"), ("1,23", "number", "円"), ("△3千円", "number", "円"), ("-", "number", "円"), ("1:30", "number", "分"),
        ("2026/4/1", "date", ""), ("2026年4月31日", "date", ""), ("2026-04-01 9:05", "datetime", ""), ("2026.4", "date", ""), ("4/1", "date", ""), ("#N/A", "date", ""), ("Ａ  1", "code", ""), ("a\nb", "string", ""), ("a\nb", "text", ""),
    ]
    entry = "struct<col:int,key:string,role:string,type:string,unit:string,fill_down:boolean,text:string,link:string,ditto:boolean,unfilled:boolean>"
    df = spark.createDataFrame([([(0, "k", "r", kind, unit, False, t, None, False, False) for t, kind, unit in rows],)], f"entries array<{entry}>")
    got = [(e["value"], e["failed"]) for e in import_plan.with_values(df, None, 2025).first()["entries"]]
    assert got == [
        ("1234.5", False), ("1000", False), ("12", False), ("1,23", True), ("-3000", False), (None, False), ("90", False), ("2026-04-01", False), ("2026年4月31日", True), ("2026-04-01 09:05", False),
        ("2026-04", False), ("2025-04-01", False), (None, False), ("A 1", False), ("a b", False), ("a\nb", False),
    ]
