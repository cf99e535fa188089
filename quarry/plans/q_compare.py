"""Registered document-comparison queries.

Version pairs from ``documents``: every document against an edited copy
(every 4th line prefixed, every 7th line dropped; pair_id = doc_id), and
neighbouring documents 2i (reference) / 2i+1 (actual) (pair_id = 10^6 + i).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import compare as CP
from quarry.plans import fixtures as FX
from quarry.plans.registry import query

W = FX.with_
NEIGHBOUR_BASE = 1_000_000
LINES_PER_PAGE = 20
EDIT_PREFIX = "EDIT: "


def doc_pairs(spark, d):
    docs = FX.table(spark, d, "documents")
    lines = F.split("text", "\n")
    edited = F.array_join(F.filter(F.transform(lines, lambda l, i: F.when((i + 1) % 4 == 0, F.concat(
        F.lit(EDIT_PREFIX), l)).otherwise(l)), lambda l, i: (i + 1) % 7 != 0), "\n")
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    ref = docs.select(F.col("doc_id").alias("pair_id"), F.lit("reference").alias("role"), "text", name.alias("name"))
    act = docs.select(F.col("doc_id").alias("pair_id"), F.lit("actual").alias("role"), edited.alias("text"),
                      name.alias("name"))
    nb = docs.select((F.lit(NEIGHBOUR_BASE) + F.floor(F.col("doc_id") / 2)).cast("long").alias("pair_id"),
                     F.when(F.col("doc_id") % 2 == 0, "reference").otherwise("actual").alias("role"),
                     "text", name.alias("name"))
    return ref.unionByName(act).unionByName(nb)


SQL_PAIRS = f"""pairs AS (
  SELECT doc_id AS pair_id, 'reference' AS role, text, source || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS name
  FROM documents
  UNION ALL
  SELECT doc_id, 'actual', array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda l, i: CASE WHEN i % 4 = 0 THEN '{EDIT_PREFIX}' || l ELSE l END), lambda l, i: i % 7 <> 0), chr(10)),
      source || '_' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents
  UNION ALL
  SELECT CAST({NEIGHBOUR_BASE} + floor(doc_id / 2) AS BIGINT), CASE WHEN doc_id % 2 = 0 THEN 'reference' ELSE 'actual' END,
      text, source || '_' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents),
lines AS (SELECT pair_id, role, i AS line_no, CAST(floor((i - 1) / {LINES_PER_PAGE}) + 1 AS BIGINT)::VARCHAR AS page,
    line FROM (SELECT pair_id, role, unnest(string_split(text, chr(10))) AS line,
                      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pairs)
  WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) <> ''),
occ AS (SELECT *, row_number() OVER (PARTITION BY pair_id, page, role, line ORDER BY line_no) AS occ FROM lines),
cmp AS (SELECT coalesce(r.pair_id, a.pair_id) AS pair_id, coalesce(r.page, a.page) AS page,
    coalesce(r.line, a.line) AS line, coalesce(r.occ, a.occ) AS occ, r.line_no AS ref_no, a.line_no AS act_no,
    CASE WHEN r.line_no IS NULL THEN 'added' WHEN a.line_no IS NULL THEN 'removed' ELSE 'same' END AS status
  FROM (SELECT * FROM occ WHERE role = 'reference') r
  FULL OUTER JOIN (SELECT * FROM occ WHERE role = 'actual') a
  ON r.pair_id = a.pair_id AND r.page = a.page AND r.line = a.line AND r.occ = a.occ),
ar AS (SELECT pair_id, page,
    count(*) FILTER (WHERE status = 'added') AS n_added, count(*) FILTER (WHERE status = 'removed') AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY coalesce(act_no, ref_no), line) FILTER (WHERE status = 'added'), '') AS added,
    coalesce(string_agg(line, chr(10) ORDER BY coalesce(act_no, ref_no), line) FILTER (WHERE status = 'removed'), '') AS removed
  FROM cmp GROUP BY pair_id, page)"""


def _lines(spark, d):
    return CP.split_lines(doc_pairs(spark, d), LINES_PER_PAGE)


@query("compare_pages", W(SQL_PAIRS) +
       "SELECT pair_id, page, line, occ, coalesce(act_no, ref_no) AS line_no, status FROM cmp")
def compare_pages(spark, d):
    return CP.compare_lines(_lines(spark, d)).select(
        "pair_id", "page", "line", "occ", F.coalesce("act_no", "ref_no").alias("line_no"), "status")


@query("added_removed", W(SQL_PAIRS) + """SELECT pair_id, page, n_added, n_removed, added, removed FROM ar
WHERE n_added > 0 OR n_removed > 0""")
def added_removed(spark, d):
    return CP.added_removed(_lines(spark, d))


@query("compare_documents", W(SQL_PAIRS) + "SELECT pair_id, page, n_added, n_removed, added, removed FROM ar")
def compare_documents(spark, d):
    """Many (reference, actual) pairs -> one row per page with Added /
    Removed (identical pages give empty lists)."""
    return CP.added_removed(_lines(spark, d), keep_identical=True)


@query("concat_sources", W(SQL_PAIRS) + """
SELECT pair_id, string_agg('===== ' || CASE WHEN role = 'reference' THEN 'REFERENCE DOCUMENT (original version)'
    ELSE 'ACTUAL DOCUMENT (updated version)' END || ': ' || name || ' =====' || chr(10) || text,
    chr(10) || chr(10) ORDER BY CASE WHEN role = 'reference' THEN 0 ELSE 1 END) AS combined
FROM pairs WHERE pair_id >= 1000000
  AND trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) <> ''
GROUP BY pair_id""")
def concat_sources(spark, d):
    """The labelled REFERENCE / ACTUAL text of each neighbour pair."""
    p = doc_pairs(spark, d).where(F.col("pair_id") >= NEIGHBOUR_BASE)
    return CP.combined_text(p)
