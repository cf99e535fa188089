"""Registered source / sink queries. File inputs are derived from the driver
tables by Spark and written once per session under the shared checkpoint
folder (documents as text files per source, customers as CSV, events as
JSON lines), then read back with the file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.plans import fixtures as FX
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.sources import files as SF

_DIRS: dict = {}


def staged_files(spark, d) -> dict[str, str]:
    key = (id(spark), d)
    if key not in _DIRS:
        root = scratch_path(spark, "files")
        FX.table(spark, d, "documents").select("source", "text").write.partitionBy("source") \
            .mode("overwrite").text(f"{root}/text")
        FX.table(spark, d, "customer").write.option("header", True).mode("overwrite").csv(f"{root}/csv")
        FX.table(spark, d, "customer").write.option("header", False).mode("overwrite").csv(f"{root}/csv_nohdr")
        FX.table(spark, d, "events").select("event_id", "event_type", "value", "props") \
            .write.mode("overwrite").json(f"{root}/json")
        _DIRS[key] = {"root": root, "text": f"{root}/text", "csv": f"{root}/csv",
                      "csv_nohdr": f"{root}/csv_nohdr", "json": f"{root}/json"}
    return _DIRS[key]


@query("scan_text_files", """
SELECT source, count(*) AS n_lines, CAST(sum(length(line) + 1) AS BIGINT) AS n_chars,
       CAST(sum(CAST('0x' || substring(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS content
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""")
def scan_text_files(spark, d):
    """Whole-text files; per source the lines, characters and the sum of
    the lines' hashes (the writer ends each document with a newline, and deals
    documents to files as it likes)."""
    t = SF.scan_text_files(spark, staged_files(spark, d)["text"])
    src = F.regexp_extract("path", r"source=([^/]+)", 1)
    lines = t.select(src.alias("source"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("line"))
    head = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line") + 1).alias("n_chars"),
                                       F.sum(head).alias("content"))


@query("scan_csv_table", """
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment""")
def scan_csv_table(spark, d):
    t = SF.scan_csv_table(spark, staged_files(spark, d)["csv"])
    return t.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"),
                                         F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("scan_csv_text", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ', ' || c_name || ', ' || CAST(c_nationkey AS VARCHAR) || ', '
  || CAST(c_acctbal AS VARCHAR) || ', ' || c_mktsegment AS line FROM customer""")
def scan_csv_text(spark, d):
    """S3: CSV rows as text lines, cells joined with ', ' (NULL -> empty)."""
    t = spark.read.option("header", False).csv(staged_files(spark, d)["csv_nohdr"])
    return t.select(F.col("_c0").cast("long").alias("c_custkey"),
                    X.linearize(F.array(*[F.col(c) for c in t.columns]), ", ").alias("line"))


@query("scan_json_docs", "SELECT event_id, event_type, value, props FROM events")
def scan_json_docs(spark, d):
    """S4 (records): JSON lines read back as records."""
    return SF.scan_json_records(spark, staged_files(spark, d)["json"]).select("event_id", "event_type", "value", "props")


@query("scan_mixed_files")
def scan_mixed_files(spark, d):
    """Every staged file routed by extension (txt, csv, json parts;
    Spark's own marker files are unsupported and land in quarantine)."""
    return SF.scan_mixed_files(spark, staged_files(spark, d)["root"]).select(
        "path", "ext", "unit", "ord", F.length("text").alias("n_chars"), "error")


@query("sniff_format")
def sniff_format(spark, d):
    """S10 over every staged file."""
    return SF.sniff_format(SF.binary_files(spark, staged_files(spark, d)["root"]))


# Stand-in files: pages under the first bytes of each format (fixed values) and under
# names that fit or do not.
_HEADS = ["", "504B0304", "D0CF11E0A1B11AE1", "255044462D312E37", "53514C69746520666F726D6174203300", "0A20", "EFBBBF", "FFFE41"]
_NAMES = [".html", ".docx", ".xls", ".pdf", ".db", ".xlsx", ".htm", ".txt", ""]


@query("sniff_formats", f"""
WITH f AS (SELECT 'in/p' || page_id || {_NAMES!r}[page_id % {len(_NAMES)} + 1] AS path, {_NAMES!r}[page_id % {len(_NAMES)} + 1] AS ext,
  {_HEADS!r}[page_id % {len(_HEADS)} + 1] AS h, lower(substring(html, 1, 30)) AS low FROM pages),
g AS (SELECT path, ext, CASE WHEN h LIKE '504B0304%' THEN 'ooxml' WHEN h LIKE 'D0CF11E0%' THEN 'biff' WHEN h LIKE '25504446%' THEN 'pdf'
  WHEN h LIKE '53514C69746520666F726D6174%' THEN 'sqlite'
  WHEN h IN ('', '0A20') AND regexp_matches(low, '^<(!doctype html|html|table|\\?xml)') THEN 'html' ELSE 'unknown' END AS format FROM f)
SELECT path, ext, format, coalesce(CASE WHEN ext IN ('.xlsx', '.docx') THEN 'ooxml' WHEN ext = '.xls' THEN 'biff' WHEN ext = '.pdf' THEN 'pdf'
  WHEN ext = '.db' THEN 'sqlite' WHEN ext IN ('.html', '.htm') THEN 'html' END <> format, false) AS mislabelled FROM g""")
def sniff_formats(spark, d):
    """S10 over files of every format, with names that fit and names that do not."""
    def nth(values):
        return F.get(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % len(values)).cast("int"))
    files = FX.table(spark, d, "pages").select(
        F.concat(F.lit("in/p"), F.col("page_id").cast("string"), nth(_NAMES)).alias("path"),
        F.concat(F.unhex(nth(_HEADS)), F.col("html").cast("binary")).alias("content"))
    return SF.sniff_format(files)


@query("linearize_rows", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) || chr(9) || coalesce(c_name, '') || chr(9) || CAST(c_nationkey AS VARCHAR)
  || chr(9) || coalesce(CASE WHEN c_acctbal < 0 THEN 'overdrawn' END, '') AS line FROM customer""")
def linearize_rows(spark, d):
    """P5: cells -> one tab-separated line, NULL cells as empty strings."""
    c = FX.table(spark, d, "customer")
    arr = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_nationkey").cast("string"),
                  F.when(F.col("c_acctbal") < 0, "overdrawn"))
    return c.select("c_custkey", X.linearize(arr, "\t").alias("line"))


def _dump_sql():
    from quarry.plans.q_ledger import _SQL_NAMES, SQL_DETECT, SQL_FIRST30
    return FX.with_(FX.SQL_CELLS, SQL_FIRST30, SQL_DETECT, _SQL_NAMES) + """,
cols AS (SELECT file, sheet, string_agg(name, ', ' ORDER BY j) AS cols FROM names GROUP BY file, sheet),
body AS (SELECT c.file, c.sheet, c.row_idx, c.cells FROM cells c JOIN dhdr h ON c.file = h.file
         AND c.sheet = h.sheet WHERE c.row_idx > h.header_idx),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY row_idx) AS r FROM body)
        WHERE r <= 1000),
lines AS (SELECT file, sheet, string_agg(array_to_string(list_transform(cells, lambda v: coalesce(v, '')), chr(9)),
          chr(10) ORDER BY row_idx) AS rows FROM top GROUP BY file, sheet)
SELECT n.file, n.sheet, n.file || '::' || n.sheet || chr(10) || '# Columns: ' || n.cols || chr(10)
       || coalesce(l.rows, '') AS text
FROM cols n LEFT JOIN lines l ON n.file = l.file AND n.sheet = l.sheet""".replace("\n,\ncols AS", ",\ncols AS", 1)


@query("dump_tables_text", _dump_sql())
def dump_tables_text(spark, d):
    """Per sheet a text dump: name line, ``# Columns: ..``, then the
    first 1000 body rows tab-joined (ordered by row index)."""
    from quarry.operators.tables_text import dump_tables
    return dump_tables(FX.cells_table(spark, d))


@query("write_corpus", FX.with_(FX.SQL_CORPUS, FX.SQL_CHUNKS) +
       "SELECT session_id, chunk_id, source || '::' || sha256(text) AS fp, md5(text) AS content FROM chunks")
def write_corpus(spark, d):
    """Chunks + fingerprints written partitioned by session, read back
    (partition pruning on session_id)."""
    from quarry.operators.corpus import fingerprint
    path = scratch_path(spark, "corpus")
    fingerprint(FX.chunks(spark, d)).write.partitionBy("session_id").mode("append").parquet(path)
    return spark.read.parquet(path).select("session_id", "chunk_id", "fp", F.md5("text").alias("content"))


def _payload_sql():
    from quarry.plans.q_multimodal import SQL_EL
    return FX.with_(SQL_EL) + "SELECT doc_id, modality, payload FROM pl"


@query("payload_store", _payload_sql())
def payload_store(spark, d):
    """Payloads stored as a table; lookups are equi-joins. Every element's
    payload is looked up."""
    from quarry.operators import multimodal as MM
    path = scratch_path(spark, "payloads")
    found = MM.payloads(MM.elements(FX.table(spark, d, "pages")))
    found.write.mode("overwrite").parquet(path)
    return found.select("doc_id").join(spark.read.parquet(path), "doc_id", "left").select("doc_id", "modality", "payload")


@query("write_tidy_ledger", """
SELECT 'ledger_' || substring(o_orderpriority, 1, 1) || '.xlsx' AS file, CAST(year(o_orderdate) AS VARCHAR) AS sheet,
       o_orderkey * 100 + 100 AS island, strftime(o_orderdate, '%Y-%m-%d') AS date,
       'Customer#' || CAST(o_custkey AS VARCHAR) AS account,
       round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 2) AS debit,
       round(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, 2) AS credit FROM orders""")
def write_tidy_ledger(spark, d):
    """Tidy rows of every ledger sheet, one partitioned write."""
    from quarry.operators.ledger_job import tidy_rows, write_tidy
    path = scratch_path(spark, "tidy")
    write_tidy(tidy_rows(FX.cells_table(spark, d)), path)
    t = spark.read.parquet(path).withColumn("sheet", F.col("sheet").cast("string"))
    return t.select("file", "sheet", "island", "date", "account", "debit", "credit")
