"""Compare document versions (C5): added / removed lines per page.

A line's identity is (pair, page, text, occurrence number), so repeated lines
are compared as a multiset (``exceptAll`` semantics) with one shuffle keyed by
(pair, page) and no pair-wise line comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import exprs as X

# Role labels of the combined comparison text.
ROLE_LABELS = {"reference": "REFERENCE DOCUMENT (original version)",
               "actual": "ACTUAL DOCUMENT (updated version)"}


def split_lines(docs: DataFrame, lines_per_page: int = 20) -> DataFrame:
    """(pair_id, role, text) -> (pair_id, role, page, line_no, line); blank
    lines are dropped after numbering, pages are ``lines_per_page`` lines."""
    ex = docs.select("pair_id", "role", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return (ex.select("pair_id", "role", (F.col("i") + 1).alias("line_no"),
                      (F.floor(F.col("i") / lines_per_page) + 1).cast("string").alias("page"), "line")
            .where(X.strip(F.col("line")) != ""))


def _occ(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair_id", "page", "role", "line").orderBy("line_no")
    return lines.withColumn("occ", F.row_number().over(w))


def compare_lines(lines: DataFrame) -> DataFrame:
    """Full outer join of reference and actual lines on (pair, page,
    line, occurrence); status same / added / removed."""
    o = _occ(lines)
    ref = o.where(F.col("role") == "reference").select("pair_id", "page", "line", "occ",
                                                       F.col("line_no").alias("ref_no"))
    act = o.where(F.col("role") == "actual").select("pair_id", "page", "line", "occ",
                                                    F.col("line_no").alias("act_no"))
    j = ref.join(act, ["pair_id", "page", "line", "occ"], "full_outer")
    status = (F.when(F.col("ref_no").isNull(), "added").when(F.col("act_no").isNull(), "removed")
              .otherwise("same"))
    return j.withColumn("status", status)


def added_removed(lines: DataFrame, keep_identical: bool = False) -> DataFrame:
    """Per (pair, page) the added and removed lines in document
    order, as newline-joined text plus counts. ``keep_identical`` also returns
    pages without changes (empty lists)."""
    c = compare_lines(lines)
    item = F.struct(F.coalesce("act_no", "ref_no").alias("n"), F.col("line"))
    g = c.groupBy("pair_id", "page").agg(
        F.array_sort(F.collect_list(F.when(F.col("status") == "added", item))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "removed", item))).alias("r"))
    out = g.select("pair_id", "page", F.size("a").alias("n_added"), F.size("r").alias("n_removed"),
                   F.array_join(F.transform("a", lambda s: s["line"]), "\n").alias("added"),
                   F.array_join(F.transform("r", lambda s: s["line"]), "\n").alias("removed"))
    if not keep_identical:
        out = out.where((F.col("n_added") > 0) | (F.col("n_removed") > 0))
    return out


def combined_text(pages: DataFrame) -> DataFrame:
    """A12 pair wrapper: ``===== REFERENCE ...: name =====\\n<text>`` then the
    ACTUAL block, blank line between, empty documents skipped; one row per
    pair (bounded by the two documents' size)."""
    label = F.when(F.col("role") == "reference", F.lit(ROLE_LABELS["reference"])) \
             .otherwise(F.lit(ROLE_LABELS["actual"]))
    block = F.concat(F.lit("===== "), label, F.lit(": "), F.col("name"), F.lit(" =====\n"), F.col("text"))
    ordk = F.when(F.col("role") == "reference", 0).otherwise(1)
    b = pages.where(X.strip(F.col("text")) != "").select("pair_id", F.struct(ordk.alias("o"), block.alias("b")).alias("s"))
    return b.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")),
                                                              lambda s: s["b"]), "\n\n").alias("combined"))
