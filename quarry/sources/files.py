"""File sources (S1-S10): text, CSV, JSON, office files, HTML tables.

Whole-file formats are read with ``binaryFile`` (one row per file, path and
bytes) and decoded by a registry of small per-file extractors inside
``mapInPandas``; Spark partitions the files, the Python side only decodes
one file at a time. A file that fails to decode yields a row with ``error``
set (quarantine) instead of failing the job.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import exprs as X

DOC_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("ext", T.StringType()),
    T.StructField("unit", T.StringType()), T.StructField("ord", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
CELL_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()),
    T.StructField("row_idx", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])

# File signatures (first bytes, hex) and their formats.
SIGNATURES = [("504B0304", "ooxml"), ("D0CF11E0", "biff"), ("25504446", "pdf"), ("53514C69746520666F726D6174", "sqlite")]


# ---------------------------------------------------------------------------
# Native readers
# ---------------------------------------------------------------------------

def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (``wholetext``), with the file path."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def scan_csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header row; inferred types unless a schema is given
    (inference is an extra pass, so production jobs pass the schema)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return r.csv(path)


def scan_json_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S4 (records): JSON lines or multi-line JSON documents."""
    return spark.read.option("multiLine", multiline).json(path)


def sniff_format(files: DataFrame) -> DataFrame:
    """Real format from the first bytes, and whether the extension
    disagrees (``mislabelled``)."""
    head = F.hex(F.substring("content", 1, 16))
    fmt = F.lit("unknown")
    for sig, name in reversed(SIGNATURES):
        fmt = F.when(head.startswith(sig), F.lit(name)).otherwise(fmt)
    low = F.lower(F.make_valid_utf8(F.substring("content", 1, 64).cast("string")))
    fmt = F.when((fmt == "unknown") & low.rlike(r"^\s*<(!doctype html|html|table|\?xml)"), "html") \
           .otherwise(fmt)
    ext = X.extension(F.col("path"))
    expected = (F.when(ext.isin(".xlsx", ".docx", ".pptx"), "ooxml").when(ext == ".xls", "biff")
                .when(ext == ".pdf", "pdf").when(ext.isin(".db", ".sqlite", ".sqlite3"), "sqlite")
                .when(ext.isin(".html", ".htm"), "html"))
    return files.select("path", ext.alias("ext"), fmt.alias("format"),
                        (expected.isNotNull() & (expected != fmt)).alias("mislabelled"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", True).load(path)


# ---------------------------------------------------------------------------
# Per-file extractors (stdlib only)
# ---------------------------------------------------------------------------

def _decode(b: bytes) -> str:
    return b.decode("utf-8", errors="replace")


def _text(b, _p):
    return [("", 0, _decode(b))]


def _csv_text(b, _p):
    rows = csv.reader(io.StringIO(_decode(b)))
    return [("", 0, "\n".join(", ".join(c for c in r) for r in rows))]


def _json_text(b, _p):
    return [("", 0, json.dumps(json.loads(_decode(b)), indent=2, ensure_ascii=False))]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _docx(b, _p):
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    paras = ["".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p")]
    return [("", 0, "\n".join(paras))]


def _pptx(b, _p):
    out = []
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)),
                       key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for i, n in enumerate(names, 1):
            root = ET.fromstring(z.read(n))
            texts = [t.text for t in root.iter(_A + "t") if t.text]
            out.append((f"Slide {i}", i, f"--- Slide {i} ---\n" + "\n".join(texts)))
    return out


def xlsx_rows(b: bytes):
    """Yield (sheet name, row index, [cell text]) from an OOXML workbook."""
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si"):
                shared.append("".join(t.text or "" for t in si.iter(_S + "t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                rels[r.get("Id")] = r.get("Target")
        for i, s in enumerate(wb.iter(_S + "sheet"), 1):
            target = rels.get(s.get(_R + "id"), f"worksheets/sheet{i}.xml").lstrip("/")
            target = target if target.startswith("xl/") else "xl/" + target
            root = ET.fromstring(z.read(target))
            for r_i, row in enumerate(root.iter(_S + "row")):
                cells = {}
                for c in row.iter(_S + "c"):
                    col = _col_index(re.sub(r"\d", "", c.get("r", "A")))
                    v = c.find(_S + "v")
                    t = c.get("t")
                    if t == "s" and v is not None:
                        cells[col] = shared[int(v.text)]
                    elif t == "inlineStr":
                        cells[col] = "".join(x.text or "" for x in c.iter(_S + "t"))
                    elif v is not None:
                        cells[col] = v.text
                width = max(cells) + 1 if cells else 0
                yield s.get("name"), int(row.get("r", r_i + 1)) - 1, [cells.get(j) for j in range(width)]


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def _xlsx_text(b, _p):
    sheets: dict[str, list[str]] = {}
    for sheet, _r, cells in xlsx_rows(b):
        sheets.setdefault(sheet, []).append("\t".join("" if c is None else c for c in cells))
    return [(s, i, f"--- Sheet: {s} ---\n" + "\n".join(lines)) for i, (s, lines) in enumerate(sheets.items(), 1)]


class _Tables(__import__("html.parser").parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self._row, self._cell, self._in = [], None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self._in += 1
        elif tag == "tr" and self._in:
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self._row.append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag == "tr" and self._row is not None:
            self.tables[-1].append(self._row)
            self._row = None
        elif tag == "table":
            self._in -= 1

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def html_tables(b: bytes):
    """(``Table n``, row index, cells) for every <table> in an HTML file."""
    p = _Tables()
    p.feed(_decode(b))
    for t_i, rows in enumerate(p.tables, 1):
        for r_i, row in enumerate(rows):
            yield f"Table {t_i}", r_i, [c if c != "" else None for c in row]


def _html_text(b, p):
    out = []
    for t_i, (name, _r, cells) in enumerate(html_tables(b)):
        out.append((name, t_i, "\t".join("" if c is None else c for c in cells)))
    return out or [("", 0, re.sub(r"<[^>]+>", " ", _decode(b)))]


# Extractor registry: lower-cased extension -> function(bytes, path).
EXTRACTORS = {".txt": _text, ".md": _text, ".csv": _csv_text, ".json": _json_text, ".docx": _docx,
              ".pptx": _pptx, ".xlsx": _xlsx_text, ".html": _html_text, ".htm": _html_text}


def _extract_docs(it):
    for pdf in it:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            m = re.search(r"[^.](\.[^./]+)$", path.rsplit("/", 1)[-1].lower())
            ext = m.group(1) if m else ""
            fn = EXTRACTORS.get(ext)
            if fn is None:
                rows.append((path, ext, "", 0, None, "unsupported"))
                continue
            try:
                for unit, ordn, text in fn(bytes(content), path):
                    rows.append((path, ext, unit, ordn, text, None))
            except Exception as e:  # noqa: BLE001 - quarantine, keep going
                rows.append((path, ext, "", 0, None, f"{type(e).__name__}: {e}"[:500]))
        yield pd.DataFrame(rows, columns=[f.name for f in DOC_SCHEMA.fields])


def scan_mixed_files(spark: SparkSession, path: str) -> DataFrame:
    """Route every file by extension to its extractor; unsupported or
    broken files become quarantine rows (``error`` set)."""
    return binary_files(spark, path).select("path", "content").mapInPandas(_extract_docs, DOC_SCHEMA)


def _extract_cells(it):
    for pdf in it:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            name = path.rsplit("/", 1)[-1]
            low = name.lower()
            b = bytes(content)
            try:
                if b[:4] == b"PK\x03\x04":
                    gen = xlsx_rows(b)
                elif low.endswith(".csv"):
                    gen = (("", i, r) for i, r in enumerate(csv.reader(io.StringIO(_decode(b)))))
                else:
                    gen = html_tables(b)
                for sheet, r_i, cells in gen:
                    rows.append((name, sheet, int(r_i), [c if c not in ("",) else None for c in cells]))
            except Exception:  # noqa: BLE001 - unreadable sheet skipped, as the reader does
                continue
        yield pd.DataFrame(rows, columns=[f.name for f in CELL_SCHEMA.fields])


def scan_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Raw cells of every sheet/table in a folder (xlsx by signature, csv,
    HTML exports mislabelled as .xls): ``cells(file, sheet, row_idx, cells)``."""
    return binary_files(spark, path).select("path", "content").mapInPandas(_extract_cells, CELL_SCHEMA)
