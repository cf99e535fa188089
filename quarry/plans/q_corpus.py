"""Registered corpus queries (C1): chunk, fingerprint, dedup, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import corpus as C
from quarry.operators import skew
from quarry.plans import fixtures as FX
from quarry.plans.registry import query

W = FX.with_


@query("chunk_fixed", W(FX.SQL_CORPUS, FX.SQL_CHUNKS) +
       "SELECT doc_id, pos, chunk_id, source, session_id, text FROM chunks")
def chunk_fixed(spark, d):
    return FX.chunks(spark, d).select("doc_id", "pos", "chunk_id", "source", "session_id", "text")


@query("fingerprint", W(FX.SQL_CORPUS, FX.SQL_CHUNKS) +
       "SELECT chunk_id, source || '::' || sha256(text) AS fp FROM chunks")
def fingerprint(spark, d):
    return C.fingerprint(FX.chunks(spark, d)).select("chunk_id", "fp")


_SQL_FP = ("fp AS (SELECT chunk_id, doc_id, session_id, source || '::' || sha256(text) AS fp "
           "FROM chunks)")


@query("incremental_new_chunks", W(FX.SQL_CORPUS, FX.SQL_CHUNKS, _SQL_FP) + """
SELECT session_id, fp, min(chunk_id) AS chunk_id FROM fp
WHERE NOT EXISTS (SELECT 1 FROM fp l JOIN labels b ON l.doc_id = b.doc_id
                  WHERE l.session_id = fp.session_id AND l.fp = fp.fp)
GROUP BY session_id, fp""")
def incremental_new_chunks(spark, d):
    """Ledger = fingerprints of the labelled documents (indexed earlier);
    new batch = the whole corpus."""
    fp = C.fingerprint(FX.chunks(spark, d))
    ledger = fp.join(FX.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi") \
               .select("session_id", "fp")
    return C.incremental_new_chunks(fp, ledger)


@query("file_manifest", W(FX.SQL_CORPUS, FX.SQL_CHUNKS) + """
SELECT session_id, len(names) AS n_files,
       CASE WHEN len(names) = 0 THEN '(no files indexed)'
            ELSE CAST(len(names) AS VARCHAR) || ' file(s): ' || array_to_string(names, ', ') END AS name
FROM (SELECT session_id, list_sort(list(DISTINCT regexp_replace(source, '_[0-9a-f]{6}(\\.[^.]+)$', '\\1')))
             AS names FROM chunks GROUP BY session_id)""")
def file_manifest(spark, d):
    return C.file_manifest(FX.chunks(spark, d))


@query("distinct_sources", W(FX.SQL_CORPUS, FX.SQL_CHUNKS) + """
SELECT session_id, count(DISTINCT source) AS n_sources, count(*) AS n_chunks
FROM chunks GROUP BY session_id""")
def distinct_sources(spark, d):
    return C.distinct_sources(FX.chunks(spark, d))


@query("list_sessions", "SELECT DISTINCT lang AS session_id FROM documents")
def list_sessions(spark, d):
    return C.list_sessions(FX.corpus(spark, d))


@query("keep_latest_sessions", W(FX.SQL_CORPUS, FX.SQL_CHUNKS) + """
SELECT session_id, chunk_id FROM chunks
WHERE session_id IN (SELECT session_id FROM (SELECT DISTINCT session_id FROM chunks)
                     ORDER BY session_id DESC LIMIT 3)""")
def keep_latest_sessions(spark, d):
    return C.keep_latest_sessions(FX.chunks(spark, d), 3).select("session_id", "chunk_id")


@query("filter_supported", W(FX.SQL_UPLOADS) + """
SELECT doc_id, path FROM uploads
WHERE regexp_extract(lower(string_split(path, '/')[-1]), '[^.](\\.[^./]+)$', 1) IN
  ('.pdf', '.docx', '.txt', '.pptx', '.md', '.csv', '.xlsx', '.xls', '.db', '.sqlite', '.sqlite3', '.json')""")
def filter_supported(spark, d):
    return C.filter_supported(FX.uploads(spark, d), "path")


@query("safe_filename", W(FX.SQL_UPLOADS) + """
SELECT doc_id, lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '([^.])\\.[^./]+$', '\\1'),
                                    '[^a-zA-Z0-9_\\-]', '_', 'g')) AS safe_name FROM uploads""")
def safe_filename(spark, d):
    return FX.uploads(spark, d).select("doc_id", C.safe_filename(F.col("path")).alias("safe_name"))


@query("clean_filename", W(FX.SQL_UPLOADS) + """
SELECT doc_id, string_split(path, '/')[-1] AS base,
       regexp_replace(string_split(path, '/')[-1], '_[0-9a-f]{6}(\\.[^.]+)$', '\\1') AS clean,
       regexp_extract(lower(string_split(path, '/')[-1]), '[^.](\\.[^./]+)$', 1) AS ext
FROM uploads""")
def clean_filename(spark, d):
    u = FX.uploads(spark, d)
    return u.select("doc_id", X.basename(F.col("path")).alias("base"),
                    C.clean_filename(X.basename(F.col("path"))).alias("clean"),
                    X.extension(F.col("path")).alias("ext"))


@query("needs_ocr", """
SELECT source, count(*) AS n_pages,
       count(*) FILTER (WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 20) AS n_scanned
FROM documents GROUP BY source""")
def needs_ocr(spark, d):
    """Each document is one page of its source file."""
    return C.needs_ocr(FX.table(spark, d, "documents").select("source", "text"))


@query("section_marked_text", """
SELECT source, page_no, '\n--- Page ' || CAST(page_no AS VARCHAR) || ' ---\n' || text AS section
FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no
      FROM documents)
WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def section_marked_text(spark, d):
    """P4 (compare variant): pages numbered per file by doc_id, blank pages
    dropped after numbering. Numbering is skew-safe (block prefix counts)."""
    docs = FX.table(spark, d, "documents").select("doc_id", "source", "text")
    pages = skew.ordinal(docs, ["source"], "doc_id", out="page_no")
    return C.section_marked(pages, "Page", drop_blank=True).select("source", "page_no", "section")
