"""Readers and writers: master and target tables, header resolution, CSV audit, workbooks (standard library only)."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def header_key(name: object) -> str:
    """Lower-case letters and digits of a header."""
    return "".join(c for c in str(name).lower() if c.isalnum())


def find_column(columns: list[str], preferred: list[str], default: int | None = 0) -> int | None:
    """Index of the first preferred header present, else `default`."""
    keys = [header_key(c) for c in columns]
    for p in preferred:
        if header_key(p) in keys:
            return keys.index(header_key(p))
    return default


def find_optional_column(columns: list[str], preferred: list[str]) -> str | None:
    """Name of the first preferred header present (the last of equal headers), else None."""
    by = {header_key(c): c for c in columns}
    return next((by[header_key(p)] for p in preferred if header_key(p) in by), None)


def load_master(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    """Reads a table by its format (parquet, csv, json, orc, xlsx) and drops rows that are all null; an empty table is an error."""
    form = form or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if form == "xlsx":
        df, _ = read_first_sheet(spark, path)
    else:
        df = spark.read.format(form).options(**({"header": "true"} if form == "csv" else {}) | options).load(path)
    df = df.dropna(how="all")
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return df


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").option("header", "true").csv(path)


def _cell(c, strings: list[str]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if v is None or v.text is None:
        return None
    return strings[int(v.text)] if kind == "s" else v.text


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order."""
    parts = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets"):
        target = parts[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def sheet_part(z: zipfile.ZipFile, name: str) -> str:
    """The part that holds a sheet; a sheet that is not there is an error."""
    for own, part in _sheets(z):
        if own == name:
            return part
    raise ValueError(f"Worksheet not found: {name}")


def parse_workbook(data: bytes) -> tuple[list[list[str | None]], str]:
    """Rows of the first sheet, and its name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name, sheet = _sheets(z)[0]
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = []
        for r in ET.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            row: list[str | None] = []
            for c in r.iter(f"{_NS}c"):
                at = _column(c.get("r")) if c.get("r") else len(row)
                row += [None] * (at + 1 - len(row))
                row[at] = _cell(c, strings)
            rows.append(row)
        return rows, name


def read_first_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """First worksheet as strings with _row_id, and its name. A workbook is one file of bounded size, so its rows are built on the driver."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows, name = parse_workbook(data)
    if not rows:
        raise ValueError("The worksheet is empty")
    header = [(h or "").strip() or f"_c{i}" for i, h in enumerate(rows[0])]
    body = [[*((r + [None] * len(header))[: len(header)]), i] for i, r in enumerate(rows[1:])]
    schema = ", ".join(f"`{h}` string" for h in header) + ", _row_id long"
    return spark.createDataFrame(body, schema), name


def workbook_bytes(rows: list[list], sheet: str = "Sheet1", numeric: set[int] = frozenset()) -> bytes:
    """A workbook with one sheet; columns in `numeric` are numbers with two decimals, all others text."""
    from xml.sax.saxutils import escape

    def ref(r: int, c: int) -> str:
        s, n = "", c + 1
        while n:
            n, k = divmod(n - 1, 26)
            s = chr(65 + k) + s
        return f"{s}{r + 1}"

    def cell(r: int, c: int, v) -> str:
        if v is None:
            return ""
        if r and c in numeric:
            return f'<c r="{ref(r, c)}" s="1"><v>{v}</v></c>'
        return f'<c r="{ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns, rel = _NS[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{main}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{ns}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="2" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def write_workbook(df: DataFrame, path: str, numeric: list[str] = ("Confidence Score",), order: str = "_row_id") -> None:
    """One sheet in row order; a sheet holds at most 1,048,575 rows, so more is an error (use parquet or csv)."""
    names = [c for c in df.columns if c != order]
    rows = df.orderBy(order).limit(1_048_576).collect() if order in df.columns else df.limit(1_048_576).collect()
    if len(rows) > 1_048_575:
        raise ValueError("too many rows for a worksheet")
    body = [names, *([r[c] for c in names] for r in rows)]
    with open(path, "wb") as f:
        f.write(workbook_bytes(body, numeric={names.index(c) for c in numeric if c in names}))
