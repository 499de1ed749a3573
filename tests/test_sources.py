"""Readers, writers, reports and the streaming extension."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tessera import fixtures
from tessera.functions import text as X
from tessera.operators import index as I
from tessera.operators import report as R
from tessera.operators.rules import INSTITUTIONS
from tessera.plans import cascade as C
from tessera.sources import tables as T
from tessera.sources import workbook as B
from tessera.streaming import resolve

NS = T._NS


def book(rows, numeric=frozenset()):
    return T.workbook_bytes(rows, numeric=set(numeric))


def two_sheets():
    """A workbook whose first sheet is kept in a part that sorts last."""
    with zipfile.ZipFile(io.BytesIO(book([["Name"], ["right"]]))) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(io.BytesIO(book([["Name"], ["wrong"]]))) as z:
        other = z.read("xl/worksheets/sheet1.xml")
    parts["xl/worksheets/sheet9.xml"] = parts["xl/worksheets/sheet1.xml"]
    parts["xl/worksheets/sheet1.xml"] = other
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(b"worksheets/sheet1.xml", b"worksheets/sheet9.xml")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, v in parts.items():
            z.writestr(n, v)
    return out.getvalue()


def test_first_sheet_by_the_workbooks_order():
    assert T.parse_workbook(two_sheets()) == ([["Name"], ["right"]], "Sheet1")


def test_read_first_sheet_and_load_master(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(book([["College Id ", "Name", ""], ["1", "a & b", "x"], [None, None, None], ["2", None, None]]))
    df, name = T.read_first_sheet(spark, str(tmp_path / "m.xlsx"))
    assert name == "Sheet1" and df.columns == ["College Id", "Name", "_c2", "_row_id"]
    assert [tuple(r) for r in df.orderBy("_row_id").collect()] == [("1", "a & b", "x", 0), (None, None, None, 1), ("2", None, None, 2)]
    (tmp_path / "m.csv").write_text("a,b\n1,x\n,\n2,\n")
    assert T.load_master(spark, str(tmp_path / "m.csv")).count() == 2
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        T.load_master(spark, str(tmp_path / "e.csv"))
    with pytest.raises(Exception, match="(?i)path"):
        T.load_master(spark, str(tmp_path / "missing.parquet"))


def test_audit_and_workbook_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "z", 1.5), (1, 'q"uote', 2.0)], "_row_id long, name string, `Confidence Score` double")
    T.write_audit(df, str(tmp_path / "audit"))
    assert sorted(r.name for r in spark.read.option("header", "true").csv(str(tmp_path / "audit")).collect()) == ['q"uote', "z"]
    T.write_workbook(df, str(tmp_path / "out.xlsx"))
    assert T.parse_workbook((tmp_path / "out.xlsx").read_bytes())[0] == [["name", "Confidence Score"], ['q"uote', "2.0"], ["z", "1.5"]]


def styled():
    """A workbook with shared strings, two styles, widths and a column to the right of the id column."""
    data = book([["Name", "ID", "Note"], ["a", "old", "n1"], ["b", None, "n2"], ["c", "kept", None]])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"].decode()
    sheet = sheet.replace('<c r="B1" ', '<c r="B1" s="1" ').replace('<c r="B2" ', '<c r="B2" s="1" ').replace("<sheetData>", '<cols><col min="1" max="3" width="30" customWidth="1"/></cols><sheetData>')
    parts["xl/worksheets/sheet1.xml"] = sheet.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, v in parts.items():
            z.writestr(n, v)
    return out.getvalue()


def test_results_in_place():
    out = B.fill(styled(), "Sheet1", "Name", "ID", {0: (7, "FOUND", 99.456), 1: ("Not Found", "NOT FOUND", None)})
    rows, _ = T.parse_workbook(out)
    assert rows == [["Name", "ID", "Match Status", "Confidence Score", "Note"], ["a", "7", "FOUND", "99.456", "n1"], ["b", "Not Found", "NOT FOUND", "0.0", "n2"], ["c", "kept"]]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        sheet, styles = ET.fromstring(z.read("xl/worksheets/sheet1.xml")), ET.fromstring(z.read("xl/styles.xml"))
    style = {c.get("r"): c.get("s") for c in sheet.iter(f"{NS}c")}
    assert style["C1"] == style["D1"] == style["B1"] == "1" and style["C2"] == style["B2"] == "1" and style["E2"] is None
    assert styles.find(f"{NS}cellXfs")[int(style["D2"])].get("numFmtId") == "2"
    widths = [(c.get("min"), c.get("max"), float(c.get("width"))) for c in sheet.iter(f"{NS}col")]
    assert ("3", "3", 30.0) in widths and ("4", "4", 30.0) in widths and ("5", "5", 30.0) in widths
    again = B.fill(out, "Sheet1", "Name", "ID", {2: (1, "NEEDS REVIEW", 50.0)})
    assert T.parse_workbook(again)[0][0] == rows[0] and T.parse_workbook(again)[0][3] == ["c", "1", "NEEDS REVIEW", "50.0"]


@pytest.mark.parametrize("wrong", [("Sheet9", "Name", "ID"), ("Sheet1", "Nom", "ID"), ("Sheet1", "Name", "Key"), ("Sheet1", "Name", "Name")])
def test_what_is_missing_is_an_error(wrong):
    with pytest.raises(ValueError):
        B.fill(styled(), *wrong, {})


def test_whole_way_from_sheet_to_sheet(spark, tmp_path):
    cases = fixtures.CASES[:6]
    (tmp_path / "t.xlsx").write_bytes(book([["College Name", "College ID", "City"], *([n, None, c] for n, c, _ in cases)]))
    target, sheet = T.read_first_sheet(spark, str(tmp_path / "t.xlsx"))
    name, city = target.columns[T.find_column(target.columns, ["college name"])], T.find_optional_column(target.columns, ["CITY"])
    master = spark.createDataFrame(fixtures.master_rows(), fixtures.MASTER_SCHEMA)
    seen = []
    rows, decisions = C.match_all(master, target, name, city, row_id="_row_id", progress=lambda done, total, what: seen.append((done, total)))
    written = R.write_back(rows, decisions, "College ID", name_column=name)
    out = B.fill_from(written, (tmp_path / "t.xlsx").read_bytes(), sheet, name, "College ID")
    got = T.parse_workbook(out)[0]
    assert got[0] == ["College Name", "College ID", "Match Status", "Confidence Score", "City"]
    assert [r[1:3] for r in got[1:]] == [["1", "FOUND"]] * 6 and [r[0] for r in got[1:]] == [c[0] for c in cases]
    assert seen == [(1, 4), (2, 4), (3, 4), (4, 4)]
    with pytest.raises(ValueError, match="missing columns"):
        C.match_all(master, target, "Nome")
    with pytest.raises(ValueError, match="must differ"):
        R.write_back(rows, decisions, name, name_column=name)
    with pytest.raises(ValueError, match="missing columns"):
        R.write_back(rows, decisions, "ID")


def test_row_order_of_reports(spark):
    rows = spark.createDataFrame([(k, f"k{k % 7}", f"n{k}") for k in range(200)], "_row_id long, match_key string, name string").repartition(6)
    decisions = spark.createDataFrame([(f"k{k}", "FOUND", k, "m", 100.0, "r") for k in range(6)], "match_key string, decision string, master_id long, matched_name string, confidence double, reason string")
    assert [r._row_id for r in R.row_audit(rows, decisions).collect()] == [k for k in range(200) if k % 7 < 6]
    assert [r._row_id for r in R.write_back(rows.withColumn("ID", F.lit("was")), decisions, "ID").collect()] == [*range(200)]


def test_nan_and_null_are_empty(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (7.0, 3)], "x double, n long")
    assert [r.v for r in df.orderBy("n").select(X.normalize(F.col("x")).alias("v")).collect()] == ["", "", "7 0"]
    keyed = C.with_keys(df, "x", "x", "x")
    assert [r.match_key for r in keyed.orderBy("n").collect()] == ["||||", "||||", "7 0||7 0||7 0"]
    master = I.validated(df.select(F.col("n").alias("master_id"), F.lit("a").alias("name"), F.col("x").alias("city"), F.lit("s").alias("state")))
    assert [r.city for r in master.orderBy("master_id").collect()] == ["", "", "7.0"]


def test_small_reports(spark):
    one = spark.createDataFrame([(1, "n", "c", "s", 97.25), (2, "m", "c", "s", 88.75)], "master_id long, name string, city string, state string, confidence double")
    assert sorted(r.v for r in one.select(R.label(one).alias("v")).collect()) == ["1 | n | c, s | Confidence: 97.2", "2 | m | c, s | Confidence: 88.8"]
    parts = spark.createDataFrame([(1, 2, 0.5), (3, 2, 1.0), (-1, 2, 0.0), (1, 0, 0.0)], "a int, b int, want double")
    assert [r.got for r in parts.select(R.safe_ratio(F.col("a"), F.col("b")).alias("got")).collect()] == [0.5, 1.0, 0.0, 0.0]
    results = spark.createDataFrame([("v1", 1), ("v2", 2)], "engine_version string, n int")
    assert [r.n for r in R.current(results, "v2").collect()] == [2]
    decisions = spark.createDataFrame([("a", "NEEDS_REVIEW", 1), ("b", "NEEDS_REVIEW", 2), ("c", "FOUND", 3)], "match_key string, decision string, master_id long")
    reviews = spark.createDataFrame([("a", 9), ("b", None), ("c", 8)], "match_key string, master_id long")
    assert sorted(tuple(r) for r in R.apply_reviews(decisions, reviews).select("match_key", "decision", "master_id").collect()) == [("a", "FOUND", 9), ("b", "NOT_FOUND", None), ("c", "FOUND", 3)]


def test_numbers_are_written_as_printf_does(spark):
    values = [0.0, 0.25, 0.75, 1.25, 12.125, 12.375, 0.625, 0.875, 99.96, 56.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [tuple(r) for r in df.select(X.fixed(F.col("v"), 1), X.fixed(F.col("v"), 2)).collect()] == [(f"{v:.1f}", f"{v:.2f}") for v in values]


def test_stream(spark, tmp_path):
    index = I.build(spark.createDataFrame(fixtures.master_rows(), fixtures.MASTER_SCHEMA), INSTITUTIONS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "ALPHA Valley College"}\n{"name": "Beta Hills College"}\n{"name": null}\n')
    stream = spark.readStream.schema("name string").json(str(tmp_path / "in"))
    query = resolve.resolve_stream(stream, index).writeStream.format("memory").queryName("resolved").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(repr, spark.table("resolved").collect())) == sorted(["Row(name='ALPHA Valley College', master_id=1)", "Row(name='Beta Hills College', master_id=None)", "Row(name=None, master_id=None)"])
