"""Registered raw-sheet and ledger queries (C4) over the ``cells`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import ledger as L
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.registry import query

W = FX.with_
_HINTS = "[" + ", ".join(f"'{h}'" for h in L.LEDGER_HINTS) + "]"
_TOKS = "[" + ", ".join(f"'{h}'" for h in L.HEADER_TOKENS) + "]"

SQL_FIRST30 = """first30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet
  ORDER BY row_idx) AS r FROM cells) WHERE r <= 30)"""
SQL_HDR = f"""hdr AS (SELECT file, sheet, coalesce(min(CASE WHEN list_contains(low, 'date')
    AND len(list_intersect(low, {_HINTS})) >= 2 THEN row_idx END), min(row_idx)) AS header_idx
  FROM (SELECT file, sheet, row_idx, list_distinct(list_transform(list_filter(cells, lambda c: c IS NOT NULL),
        lambda c: lower({S.strip('c')}))) AS low FROM first30) GROUP BY file, sheet)"""
SQL_DETECT = f"""first25 AS (SELECT * FROM first30 WHERE r <= 25),
scored AS (SELECT file, sheet, row_idx,
    len(list_filter(cells, lambda c: c IS NOT NULL AND
        len(list_intersect(string_split_regex(lower({S.strip('c')}), '\\s+'), {_TOKS})) > 0)) AS score,
    len(list_filter(cells, lambda c: c IS NOT NULL)) AS filled FROM first25),
dhdr AS (SELECT file, sheet, CASE WHEN max(score) >= 2 THEN first(row_idx ORDER BY score DESC, row_idx)
    ELSE first(row_idx ORDER BY filled DESC, row_idx) END AS header_idx FROM scored GROUP BY file, sheet)"""
BASE = W(FX.SQL_CELLS, SQL_FIRST30, SQL_HDR)[:-1]
_MARK = f"lower({S.strip('cells[2]')}) IN ('to', 'by')"
SQL_BODY = """body AS (SELECT c.* FROM cells c JOIN hdr h ON c.file = h.file AND c.sheet = h.sheet
  WHERE c.row_idx > h.header_idx)"""
SQL_KIND = f"""kind AS (SELECT file, sheet, CASE WHEN tot > 0 AND tb / tot > 0.3 THEN 'tally' ELSE 'clean' END AS kind
  FROM (SELECT file, sheet,
          count(*) FILTER (WHERE cells[2] IS NOT NULL AND {S.strip('cells[2]')} <> '') AS tot,
          count(*) FILTER (WHERE cells[2] IS NOT NULL AND {S.strip('cells[2]')} <> '' AND {_MARK}) AS tb
        FROM body GROUP BY file, sheet))"""
SQL_REC = f"""isl AS (SELECT *, max(CASE WHEN {_MARK} THEN row_idx END) OVER (PARTITION BY file, sheet
    ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island,
    coalesce({_MARK}, false) AS is_m FROM body),
dets AS (SELECT file, sheet, island, row_idx, p, t FROM (
    SELECT file, sheet, island, row_idx, unnest(range(len(texts))) AS p, unnest(texts) AS t FROM (
      SELECT *, list_filter(list_transform(list_filter(cells, lambda c: c IS NOT NULL), lambda c: {S.strip('c')}),
                            lambda t: t <> '' AND {S.amount('t')} IS NULL) AS texts
      FROM isl WHERE island IS NOT NULL AND NOT is_m))),
ddet AS (SELECT file, sheet, island, string_agg(t, '; ' ORDER BY r0, p0) AS details FROM (
    SELECT file, sheet, island, t, min(row_idx) AS r0, arg_min(p, row_idx * 1000 + p) AS p0
    FROM dets GROUP BY file, sheet, island, t) GROUP BY file, sheet, island),
heads AS (SELECT file, sheet, island, cells AS h FROM isl WHERE is_m),
rec AS (SELECT h.file, h.sheet, h.island,
    strftime({S.coerce_date('h.h[1]')}, '%Y-%m-%d') AS date,
    {S.strip('h.h[2]')} AS type,
    coalesce({S.strip('h.h[3]')}, '') AS account,
    coalesce({S.strip('h.h[4]')}, '') AS voucher_type,
    list_max(list_filter(list_transform(h.h, lambda c: {S.amount('c')}), lambda v: v IS NOT NULL)) AS amt,
    coalesce(d.details, '') AS details
  FROM heads h LEFT JOIN ddet d ON h.file = d.file AND h.sheet = d.sheet AND h.island = d.island),
tidy AS (SELECT file, sheet, island, date, type, account, voucher_type,
    CASE WHEN lower(type) = 'to' THEN amt END AS debit,
    CASE WHEN lower(type) <> 'to' AND type <> '' THEN amt END AS credit, details FROM rec)"""
REC = BASE + ",\n" + SQL_BODY + ",\n" + SQL_REC + "\n"


def _cells(spark, d):
    return FX.cells_table(spark, d)


@query("ledger_header", BASE + "\nSELECT file, sheet, header_idx FROM hdr")
def ledger_header(spark, d):
    return L.ledger_header(_cells(spark, d))


@query("detect_header", W(FX.SQL_CELLS, SQL_FIRST30, SQL_DETECT) + "SELECT file, sheet, header_idx FROM dhdr")
def detect_header(spark, d):
    return L.detect_header(_cells(spark, d))


_SQL_NAMES = f"""hrow AS (SELECT c.file, c.sheet, c.cells FROM cells c JOIN dhdr h ON c.file = h.file
    AND c.sheet = h.sheet AND c.row_idx = h.header_idx),
raw AS (SELECT file, sheet, i - 1 AS j, cells[i] AS c FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM hrow)),
base AS (SELECT file, sheet, j, CASE WHEN {S.is_blank('c')} THEN 'col' || CAST(j AS VARCHAR) ELSE {S.strip('c')} END AS b
    FROM raw),
names AS (SELECT file, sheet, j, CASE WHEN occ = 0 THEN b ELSE b || '_' || CAST(occ AS VARCHAR) END AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet, b ORDER BY j) - 1 AS occ FROM base))"""


@query("dedupe_column_names", W(FX.SQL_CELLS, SQL_FIRST30, SQL_DETECT, _SQL_NAMES) +
       "SELECT file, sheet, j, name FROM names")
def dedupe_column_names(spark, d):
    c = _cells(spark, d)
    return L.column_names(c, L.detect_header(c))


@query("sheet_title_parts", BASE + f""",
ex AS (SELECT file, sheet, row_idx, j, {S.strip('c')} AS t FROM (
    SELECT c.file, c.sheet, c.row_idx, i - 1 AS j, c.cells[i] AS c FROM (
      SELECT c.*, unnest(range(1, len(c.cells) + 1)) AS i FROM cells c JOIN hdr h
      ON c.file = h.file AND c.sheet = h.sheet WHERE c.row_idx < h.header_idx) c)
    WHERE NOT {S.is_blank('c')})
SELECT file, sheet, string_agg(t, ' | ' ORDER BY row_idx, j) AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY row_idx, j) AS r FROM ex) WHERE r <= 6
GROUP BY file, sheet""")
def sheet_title_parts(spark, d):
    c = _cells(spark, d)
    return L.title_parts(c, L.ledger_header(c))


@query("assemble_ledger_records", REC + """SELECT file, sheet, island, date, type, account, voucher_type,
  debit, credit, details FROM tidy""")
def assemble_ledger_records(spark, d):
    c = _cells(spark, d)
    return L.assemble_records(c, L.ledger_header(c))


@query("ordered_distinct_details", REC + "SELECT file, sheet, island, details FROM tidy")
def ordered_distinct_details(spark, d):
    return assemble_ledger_records(spark, d).select("file", "sheet", "island", "details")


@query("control_totals", REC + """SELECT file, sheet, count(*) AS n_rows, round(sum(debit), 2) AS debit,
  round(sum(credit), 2) AS credit FROM tidy GROUP BY file, sheet""")
def control_totals(spark, d):
    return L.control_totals(assemble_ledger_records(spark, d))


_SQL_CLEAN = f"""clean AS (SELECT * FROM body WHERE NOT list_bool_or(list_transform(cells, lambda c:
    coalesce(lower({S.strip('c')}) IN ('total', 'grand total'), false)))
  AND NOT list_bool_and(list_transform(cells, lambda c: c IS NULL))),
lc AS (SELECT file, sheet, row_idx, i - 1 AS j, cells[i] AS c FROM (
    SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM clean)),
numcols AS (SELECT file, sheet, j, count(c) AS n_non_null, count({S.num('c')}) AS n_numeric
    FROM lc GROUP BY file, sheet, j)"""


@query("tidy_ledgers", REC[:-1] + ",\n" + SQL_KIND + ",\n" + _SQL_CLEAN + """,
meta AS (SELECT file, sheet, string_agg(t, ' | ' ORDER BY row_idx, j) AS meta FROM (
    SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY row_idx, j) AS r FROM (
      SELECT c.file, c.sheet, c.row_idx, i - 1 AS j, """ + S.strip("c.cells[i]") + """ AS t FROM (
        SELECT c.*, unnest(range(1, len(c.cells) + 1)) AS i FROM cells c JOIN hdr h
        ON c.file = h.file AND c.sheet = h.sheet WHERE c.row_idx < h.header_idx) c
      WHERE NOT """ + S.is_blank("c.cells[i]") + """)) WHERE r <= 6 GROUP BY file, sheet),
tally AS (SELECT file, sheet, count(*) AS n_rows, round(sum(debit), 2) AS debit, round(sum(credit), 2) AS credit
    FROM tidy GROUP BY file, sheet),
passed AS (SELECT file, sheet, count(*) AS n_rows FROM clean GROUP BY file, sheet)
SELECT k.file, k.sheet, k.kind,
  coalesce(CASE WHEN k.kind = 'tally' THEN t.n_rows ELSE p.n_rows END, 0) AS n_rows,
  CASE WHEN k.kind = 'tally' THEN t.debit END AS debit,
  CASE WHEN k.kind = 'tally' THEN t.credit END AS credit, m.meta
FROM kind k LEFT JOIN tally t ON k.file = t.file AND k.sheet = t.sheet
LEFT JOIN passed p ON k.file = p.file AND k.sheet = p.sheet
LEFT JOIN meta m ON k.file = m.file AND k.sheet = m.sheet""")
def tidy_ledgers(spark, d):
    from quarry.operators.ledger_job import tidy_summary
    return tidy_summary(_cells(spark, d))


@query("infer_numeric_columns", W(FX.SQL_CELLS, SQL_FIRST30, SQL_DETECT, _SQL_NAMES) + f"""
, lcb AS (SELECT c.file, c.sheet, i - 1 AS j, c.cells[i] AS v FROM (
    SELECT c.*, unnest(range(1, len(c.cells) + 1)) AS i FROM cells c JOIN dhdr h
    ON c.file = h.file AND c.sheet = h.sheet WHERE c.row_idx > h.header_idx) c)
SELECT n.file, n.sheet, n.j, n.name, count(v) AS n_non_null, count({S.num('v')}) AS n_numeric,
       count({S.num('v')}) >= count(v) * 0.6 AS is_numeric
FROM lcb JOIN names n ON lcb.file = n.file AND lcb.sheet = n.sheet AND lcb.j = n.j
GROUP BY n.file, n.sheet, n.j, n.name""".replace("\n, lcb", ",\nlcb", 1))
def infer_numeric_columns(spark, d):
    c = _cells(spark, d)
    h = L.detect_header(c)
    nc = L.numeric_columns(L.body(c, h))
    return nc.join(L.column_names(c, h), ["file", "sheet", "j"]).select(
        "file", "sheet", "j", "name", "n_non_null", "n_numeric", "is_numeric")


@query("sum_excluding_totals", BASE + ",\n" + SQL_BODY + ",\n" + SQL_KIND + ",\n" + _SQL_CLEAN + f"""
SELECT lc.file, lc.sheet, lc.j, round(sum({S.num('c')}), 2) AS total
FROM lc JOIN numcols n ON lc.file = n.file AND lc.sheet = n.sheet AND lc.j = n.j
JOIN kind k ON lc.file = k.file AND lc.sheet = k.sheet
WHERE k.kind = 'clean' AND n.n_numeric >= n.n_non_null * 0.6
GROUP BY lc.file, lc.sheet, lc.j""")
def sum_excluding_totals(spark, d):
    from quarry.operators.ledger_job import clean_sums
    return clean_sums(_cells(spark, d))


@query("labeled_row_lookup", W(FX.SQL_CELLS) + f"""
SELECT file, sheet, row_idx, j, v AS value FROM (
  SELECT file, sheet, row_idx, i - 1 AS j, {S.amount('cells[i]')} AS v FROM (
    SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM cells
    WHERE list_bool_or(list_transform(cells, lambda c: coalesce(contains(lower(c), 'grand total'), false)))))
WHERE v IS NOT NULL AND NOT isnan(v)""")
def labeled_row_lookup(spark, d):
    return L.labeled_row_values(_cells(spark, d), "grand total").select(
        "file", "sheet", "row_idx", "j", "value")


@query("parse_amount", W(FX.SQL_CELLS) + f"""
SELECT file, sheet, row_idx, j, v AS amount FROM (
  SELECT file, sheet, row_idx, i - 1 AS j, {S.amount('cells[i]')} AS v FROM (
    SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM cells)) WHERE v IS NOT NULL""")
def parse_amount(spark, d):
    lc = L.long_cells(_cells(spark, d))
    return lc.select("file", "sheet", "row_idx", "j", X.parse_amount(F.col("c")).alias("amount")) \
             .where(F.col("amount").isNotNull())


@query("largest_number", W(FX.SQL_CELLS) + f"""
SELECT file, sheet, row_idx, amount FROM (
  SELECT file, sheet, row_idx, list_max(list_filter(list_transform(cells, lambda c: {S.amount('c')}),
         lambda v: v IS NOT NULL)) AS amount FROM cells) WHERE amount IS NOT NULL""")
def largest_number(spark, d):
    c = _cells(spark, d)
    return c.select("file", "sheet", "row_idx", X.largest_number(F.col("cells")).alias("amount")) \
            .where(F.col("amount").isNotNull())


@query("coerce_date", W(FX.SQL_CELLS) + f"""
SELECT file, sheet, row_idx, strftime({S.coerce_date('cells[1]')}, '%Y-%m-%d') AS d,
  strftime(CASE WHEN year({S.coerce_date('cells[1]')}) >= 2000 THEN {S.coerce_date('cells[1]')} END,
           '%Y-%m-%d') AS d2000
FROM cells WHERE {S.coerce_date('cells[1]')} IS NOT NULL""")
def coerce_date(spark, d):
    c = _cells(spark, d)
    first = F.get("cells", 0)
    return c.select("file", "sheet", "row_idx",
                    F.date_format(X.coerce_date(first), "yyyy-MM-dd").alias("d"),
                    F.date_format(X.coerce_date(first, min_year=2000), "yyyy-MM-dd").alias("d2000")) \
            .where(F.col("d").isNotNull())
