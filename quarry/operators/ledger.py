"""Messy sheets and multi-row ledgers (C4) over long-form raw cells.

Input: ``cells(file, sheet, row_idx, cells ARRAY<STRING>)``, one row per sheet
row, ``row_idx`` carried from the reader (never generated). Everything is
keyed by (file, sheet); the only running computation (which record a row
belongs to) uses the skew-safe ``carry_forward``, so a giant sheet is split
into blocks instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import skew
from quarry.operators.retrieve import top_k

SHEET = ["file", "sheet"]

# Words that mark header cells (general tables).
HEADER_TOKENS = ["date", "debit", "credit", "particular", "particulars", "amount", "vch",
                 "voucher", "balance", "name", "qty", "quantity", "price", "rate", "total",
                 "description", "sr", "sno", "invoice", "gst", "hsn", "account", "ledger",
                 "type", "ref", "narration", "value", "id", "email", "question", "answer"]
# Ledger header hints and the Dr/Cr record markers.
LEDGER_HINTS = ["date", "debit", "credit", "particulars", "vch", "amount"]
MARKERS = ["to", "by"]
TOTAL_LABELS = ["total", "grand total"]


def _low_cells():
    return F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: F.lower(X.strip(c)))


def ledger_header(cells: DataFrame, scan: int = 30) -> DataFrame:
    """First of the first ``scan`` rows holding a ``date`` cell and at
    least two hint cells; else the sheet's first row."""
    first = top_k(cells, scan, SHEET, [F.col("row_idx")], "_r")
    low = F.array_distinct(_low_cells())
    ok = F.array_contains(low, "date") & (F.size(F.array_intersect(low, F.array(*[F.lit(h) for h in LEDGER_HINTS]))) >= 2)
    return first.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(ok, F.col("row_idx"))),
                                                F.min("row_idx")).alias("header_idx"))


def detect_header(cells: DataFrame, scan: int = 25) -> DataFrame:
    """Among the first ``scan`` rows the one with most cells containing a
    header word (score >= 2, earliest wins), else the row with most non-null
    cells (earliest wins)."""
    first = top_k(cells, scan, SHEET, [F.col("row_idx")], "_r")
    toks = F.array(*[F.lit(t) for t in HEADER_TOKENS])
    score = F.size(F.filter("cells", lambda c: c.isNotNull() & F.arrays_overlap(
        F.split(F.lower(X.strip(c)), r"\s+"), toks)))
    filled = F.size(F.filter("cells", lambda c: c.isNotNull()))
    s = first.select(*SHEET, "row_idx", score.alias("score"), filled.alias("filled"))
    best = s.groupBy(*SHEET).agg(
        F.max("score").alias("best"),
        F.min_by("row_idx", F.struct(-F.col("score"), F.col("row_idx"))).alias("by_score"),
        F.min_by("row_idx", F.struct(-F.col("filled"), F.col("row_idx"))).alias("by_filled"))
    return best.select(*SHEET, F.when(F.col("best") >= 2, F.col("by_score"))
                       .otherwise(F.col("by_filled")).alias("header_idx"))


def column_names(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Header cells -> names; blank -> ``col{j}``; a repeat gets
    the first of ``_1``, ``_2``, ... that is still free, in column order. Output (file, sheet, j, name)."""
    h = cells.join(header, SHEET).where(F.col("row_idx") == F.col("header_idx"))
    base = F.transform("cells", lambda c, j: F.when(X.is_blank(c), F.concat(F.lit("col"), j.cast("string"))).otherwise(X.strip(c)))

    def free(taken, b):
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.concat(b, F.lit("_"), k.cast("string")))
        first = F.element_at(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 1)
        return F.when(F.array_contains(taken, b), first).otherwise(b)
    names = F.aggregate(base, F.array().cast("array<string>"), lambda taken, b: F.concat(taken, F.array(free(taken, b))))
    return h.select(*SHEET, F.posexplode(names).alias("j", "name"))


def title_parts(cells: DataFrame, header: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` non-blank cells above the header, joined with ' | '."""
    above = cells.join(header, SHEET).where(F.col("row_idx") < F.col("header_idx"))
    ex = above.select(*SHEET, "row_idx", F.posexplode("cells").alias("j", "c")) \
              .where(~X.is_blank(F.col("c")))
    ex = top_k(ex, n, SHEET, [F.col("row_idx"), F.col("j")], "_r")
    return ex.groupBy(*SHEET).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("row_idx", "j", X.strip(F.col("c")).alias("t")))),
        lambda s: s["t"]), " | ").alias("title"))


def body(cells: DataFrame, header: DataFrame) -> DataFrame:
    return cells.join(header, SHEET).where(F.col("row_idx") > F.col("header_idx")).drop("header_idx")


def marker_of(c="cells"):
    return F.lower(X.strip(F.get(F.col(c) if isinstance(c, str) else c, 1)))


def ledger_kind(cells: DataFrame, header: DataFrame, share: float = 0.3) -> DataFrame:
    """R10 routing: share of To/By markers among non-blank second cells."""
    b = body(cells, header)
    second = F.get("cells", 1)
    nonblank = second.isNotNull() & (X.strip(second) != "")
    return b.groupBy(*SHEET).agg(
        F.count_if(nonblank).alias("tot"),
        F.count_if(nonblank & marker_of().isin(MARKERS)).alias("tb")).select(
        *SHEET, F.when((F.col("tot") > 0) & (F.col("tb") / F.col("tot") > share), "tally")
        .otherwise("clean").alias("kind"))


def assemble_records(cells: DataFrame, header: DataFrame) -> DataFrame:
    """A To/By row opens a record; following rows attach to it (their
    non-numeric text cells become ordered distinct details); rows before the
    first marker are dropped. Island ids come from the skew-safe carry."""
    b = body(cells, header)
    is_m = marker_of().isin(MARKERS)
    b = b.withColumn("_m", F.when(is_m, F.col("row_idx")))
    b = skew.carry_forward(b, SHEET, "row_idx", "_m", "island").where(F.col("island").isNotNull())
    texts = F.filter(F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: X.strip(c)),
                     lambda t: (t != "") & X.parse_amount(t).isNull())
    # one shuffle: each record's marker row and its detail rows meet in one
    # group (a record is one transaction: a handful of rows)
    rec = b.groupBy(*SHEET, "island").agg(
        F.max_by(F.when(F.col("_m").isNotNull(), F.col("cells")), F.col("_m").isNotNull()).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("_m").isNull(), F.struct("row_idx", texts.alias("t")))))
        .alias("rest"))
    h = F.col("head")
    typ = X.strip(F.get(h, 1))
    amount = X.largest_number(h)
    acc = F.get(h, 2)
    vch = F.get(h, 3)
    details = F.array_join(F.array_distinct(F.flatten(F.transform("rest", lambda r: r["t"]))), "; ")
    return rec.select(
        *SHEET, "island",
        F.date_format(X.coerce_date(F.get(h, 0)), "yyyy-MM-dd").alias("date"),
        typ.alias("type"),
        F.coalesce(X.strip(acc), F.lit("")).alias("account"),
        F.coalesce(X.strip(vch), F.lit("")).alias("voucher_type"),
        F.when(F.lower(typ) == "to", amount).alias("debit"),
        F.when((F.lower(typ) != "to") & (typ != ""), amount).alias("credit"),
        details.alias("details"))


def clean_rows(cells: DataFrame, header: DataFrame) -> DataFrame:
    """A8 (first half): pass-through sheet body without all-blank rows and
    without rows holding a 'total' / 'grand total' cell."""
    b = body(cells, header)
    low = F.transform("cells", lambda c: F.lower(X.strip(c)))
    has_total = F.exists(low, lambda c: F.coalesce(c.isin(TOTAL_LABELS), F.lit(False)))
    all_blank = F.forall("cells", lambda c: c.isNull())
    return b.where(~has_total & ~all_blank)


def long_cells(rows: DataFrame) -> DataFrame:
    return rows.select(*SHEET, "row_idx", F.posexplode("cells").alias("j", "c"))


def numeric_columns(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """A column is numeric when parseable cells >= 0.6 x non-null cells
    (an all-null column counts as numeric). One aggregation over long cells."""
    lc = long_cells(rows)
    return lc.groupBy(*SHEET, "j").agg(
        F.count("c").alias("n_non_null"), F.count(X.num(F.col("c"))).alias("n_numeric")).withColumn(
        "is_numeric", F.col("n_numeric") >= F.col("n_non_null") * share)


def control_totals(tidy: DataFrame, digits: int = 2) -> DataFrame:
    """Row count and Debit / Credit sums per sheet."""
    return tidy.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.round(F.sum("debit"), digits).alias("debit"),
                                    F.round(F.sum("credit"), digits).alias("credit"))


def labeled_row_values(cells: DataFrame, label: str) -> DataFrame:
    """Rows whose label appears in any cell (case-insensitive contains),
    with their numeric cells, one row per value; empty when none match."""
    hit = F.exists("cells", lambda c: F.coalesce(F.lower(c).contains(label.lower()), F.lit(False)))
    r = cells.where(hit)
    vals = F.transform("cells", lambda c: X.parse_amount(c))
    return r.select(*SHEET, "row_idx", F.posexplode(vals).alias("j", "value")) \
            .where(F.col("value").isNotNull() & ~F.isnan("value"))
