"""Behavioural cases of the reference's ingestion tests, on Spark."""

import io
import json
import os
import sqlite3
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import compare as CP
from quarry.operators import corpus as C
from quarry.sources import files as SF


def test_dedup_ledger_adds_two_then_zero(spark):
    rows = [("a", "s", 1), ("b", "s", 2)]
    df = spark.createDataFrame(rows, "text string, source string, row_id long") \
        .withColumn("session_id", F.lit("x")).withColumn("chunk_id", F.col("row_id").cast("string"))
    fp = C.fingerprint(df, row_id="row_id")
    assert sorted(r.fp for r in fp.collect()) == ["s::1", "s::2"]
    empty = spark.createDataFrame([], "session_id string, fp string")
    added = C.incremental_new_chunks(fp, empty)
    assert added.count() == 2
    again = C.incremental_new_chunks(fp, added.select("session_id", "fp"))
    assert again.count() == 0


def test_fingerprint_without_row_id_uses_content_hash(spark):
    import hashlib
    df = spark.createDataFrame([("hello", "f.txt"), ("hello", None)], "text string, source string")
    got = sorted(r.fp for r in C.fingerprint(df).collect())
    h = hashlib.sha256(b"hello").hexdigest()
    assert got == sorted([f"f.txt::{h}", h])


def test_empty_build_raises(spark):
    from quarry.operators.build import build_corpus
    empty = spark.createDataFrame([], "doc_id long, source string, session_id string, text string")
    with pytest.raises(ValueError):
        build_corpus(spark, empty, tempfile.mkdtemp(prefix="qc-"))


def test_build_corpus_is_idempotent(spark):
    from quarry.operators.build import build_corpus
    docs = spark.createDataFrame([(1, "a.txt", "s1", "x " * 700), (2, "b.txt", "s1", "y " * 300)],
                                 "doc_id long, source string, session_id string, text string")
    path = tempfile.mkdtemp(prefix="qc-") + "/corpus"
    first = build_corpus(spark, docs, path).count()
    second = build_corpus(spark, docs, path).count()
    assert first == 3 and second == 0
    assert spark.read.parquet(path).count() == 3


def _docx(text):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml",
                   '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
                   f'<w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t></w:r></w:p>'
                   '</w:body></w:document>')
    return b.getvalue()


def _pptx(slides):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for i, t in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml",
                       '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
                       'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">'
                       f'<a:t>{t}</a:t></p:sld>')
    return b.getvalue()


def _xlsx(rows):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><sheets><sheet name="Data" sheetId="1"/>'
                                      '</sheets></workbook>')
        body = "".join(
            f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>'
                                       for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return b.getvalue()


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="qfiles-")
    files = {
        "a.txt": b"plain text", "b.md": b"# title\nbody", "c.csv": b"a,b\n1,2\n",
        "d.json": json.dumps({"k": [1, 2]}).encode(), "e.docx": _docx("hello docx"),
        "f.pptx": _pptx(["one", "two"]), "g.xlsx": _xlsx([["Date", "Amount"], ["2024-01-01", "5"]]),
        "h.html": b"<html><table><tr><td>x</td><td>y</td></tr></table></html>",
        "bad.exe": b"MZ\x00\x00", "broken.docx": b"not a zip at all",
        "export.xls": b"<html><table><tr><th>Name</th><th>Total</th></tr><tr><td>p</td><td>3</td></tr></table>",
    }
    for n, b in files.items():
        with open(os.path.join(d, n), "wb") as f:
            f.write(b)
    return d


def test_files_routed_by_extension(spark, folder):
    rows = SF.scan_mixed_files(spark, folder).collect()
    by = {os.path.basename(r.path): r for r in rows}
    assert by["a.txt"].text == "plain text"
    assert by["c.csv"].text == "a, b\n1, 2"
    assert '"k"' in by["d.json"].text and "\n" in by["d.json"].text
    assert by["e.docx"].text == "hello docx\nsecond"
    assert by["g.xlsx"].text.startswith("--- Sheet: Data ---")
    slides = sorted(r.text for r in rows if r.path.endswith("f.pptx"))
    assert slides == ["--- Slide 1 ---\none", "--- Slide 2 ---\ntwo"]
    assert by["bad.exe"].error == "unsupported"
    assert by["broken.docx"].error is not None


def test_sniff_detects_mislabelled_export(spark, folder):
    s = {os.path.basename(r.path): r for r in SF.sniff_format(SF.binary_files(spark, folder)).collect()}
    assert s["e.docx"].format == "ooxml" and not s["e.docx"].mislabelled
    assert s["export.xls"].format == "html" and s["export.xls"].mislabelled


def test_html_and_xlsx_cells(spark, folder):
    cells = SF.scan_sheets(spark, folder).collect()
    exp = [r for r in cells if r.file == "export.xls"]
    assert [list(r.cells) for r in sorted(exp, key=lambda r: r.row_idx)] == [["Name", "Total"], ["p", "3"]]
    x = [r for r in cells if r.file == "g.xlsx"]
    assert x and x[0].sheet == "Data"


def test_sqlite_tables_skip_internal(spark):
    from quarry.sources.sqlite_source import scan_sqlite_tables
    p = tempfile.mkdtemp(prefix="qsql-") + "/t.sqlite"
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE t1 (a INTEGER, b TEXT)")
    con.executemany("INSERT INTO t1 VALUES (?, ?)", [(i, f"v{i}") for i in range(250)])
    con.execute("CREATE TABLE t2 (x REAL)")
    con.execute("INSERT INTO t2 VALUES (1.5)")
    con.commit()
    con.close()
    df = scan_sqlite_tables(spark, [p], rows_per_partition=100)
    counts = {r.tbl: r.n for r in df.groupBy("tbl").agg(F.count("*").alias("n")).collect()}
    assert counts == {"t1": 250, "t2": 1}
    assert df.rdd.getNumPartitions() >= 3


def test_compare_role_labels_and_diff_identity(spark):
    docs = spark.createDataFrame([(1, "reference", "a\nb\nc", "r.txt"), (1, "actual", "a\nc\nd", "a.txt")],
                                 "pair_id long, role string, text string, name string")
    combined = CP.combined_text(docs).first().combined
    assert "REFERENCE DOCUMENT (original version): r.txt" in combined
    assert "ACTUAL DOCUMENT (updated version): a.txt" in combined
    ar = CP.added_removed(CP.split_lines(docs)).first()
    assert (ar.added, ar.removed) == ("d", "b")
    swapped = docs.withColumn("role", F.when(F.col("role") == "reference", "actual").otherwise("reference"))
    ar2 = CP.added_removed(CP.split_lines(swapped)).first()
    assert (ar2.added, ar2.removed) == (ar.removed, ar.added)


def test_stream_replay_adds_nothing(spark, folder):
    from quarry.streaming.index_stream import stream_index
    src = tempfile.mkdtemp(prefix="qsrc-")
    for i in range(3):
        with open(f"{src}/doc{i}.txt", "w") as f:
            f.write(f"document {i} " * 200)
    corpus = tempfile.mkdtemp(prefix="qcorp-") + "/c"
    stream_index(spark, src, corpus, tempfile.mkdtemp(prefix="qck-"))
    n1 = spark.read.parquet(corpus).count()
    stream_index(spark, src, corpus, tempfile.mkdtemp(prefix="qck-"))
    assert spark.read.parquet(corpus).count() == n1 > 0
