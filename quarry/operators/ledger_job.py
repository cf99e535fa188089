"""R10 tidy_ledgers: a folder of raw sheets -> tidy rows + per-sheet report.

One job over all sheets at once: header detection (W3), routing by the
To/By marker share, record assembly (W5) for ledger sheets, total-row
removal and numeric inference (A8/A14) for pass-through sheets, and control
totals (A9). Sheets are never looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import ledger as L


def tidy_rows(cells: DataFrame) -> DataFrame:
    """Tidy ledger rows of every sheet routed to the ledger path."""
    h = L.ledger_header(cells)
    kind = L.ledger_kind(cells, h).where(F.col("kind") == "tally")
    return L.assemble_records(cells.join(kind.select(*L.SHEET), L.SHEET, "left_semi"), h)


def clean_sums(cells: DataFrame) -> DataFrame:
    """Per pass-through sheet, sums of numeric columns after dropping
    total and blank rows."""
    h = L.ledger_header(cells)
    kind = L.ledger_kind(cells, h).where(F.col("kind") == "clean").select(*L.SHEET)
    rows = L.clean_rows(cells, h).join(kind, L.SHEET, "left_semi")
    nc = L.numeric_columns(rows).where("is_numeric").select(*L.SHEET, "j")
    lc = L.long_cells(rows).join(nc, L.SHEET + ["j"])
    return lc.groupBy(*L.SHEET, "j").agg(F.round(F.sum(X.num(F.col("c"))), 2).alias("total"))


def tidy_summary(cells: DataFrame) -> DataFrame:
    """Per sheet: kind, row count, Debit / Credit totals (ledger sheets) and
    the title line above the header. The two per-sheet tables (header row,
    kind) are small and feed four branches, so they are materialised once."""
    h = L.ledger_header(cells).checkpoint(eager=True)
    kind = L.ledger_kind(cells, h).checkpoint(eager=True)
    tally = L.control_totals(L.assemble_records(
        cells.join(kind.where(F.col("kind") == "tally").select(*L.SHEET), L.SHEET, "left_semi"), h))
    passed = (L.clean_rows(cells, h).join(kind.where(F.col("kind") == "clean").select(*L.SHEET),
                                          L.SHEET, "left_semi")
              .groupBy(*L.SHEET).agg(F.count(F.lit(1)).alias("p_rows")))
    meta = L.title_parts(cells, h).withColumnRenamed("title", "meta")
    out = (kind.join(tally, L.SHEET, "left").join(passed, L.SHEET, "left").join(meta, L.SHEET, "left"))
    is_t = F.col("kind") == "tally"
    return out.select(*L.SHEET, "kind",
                      F.coalesce(F.when(is_t, F.col("n_rows")).otherwise(F.col("p_rows")), F.lit(0))
                      .cast("long").alias("n_rows"),
                      F.when(is_t, F.col("debit")).alias("debit"),
                      F.when(is_t, F.col("credit")).alias("credit"), "meta")


def write_tidy(tidy: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One multi-sheet write, partitioned by (file, sheet); inputs whose
    name ends in ``_clean`` are skipped so re-runs do not re-clean outputs."""
    keep = ~X.stem(F.col("file")).endswith("_clean")
    (tidy.where(keep).write.mode("overwrite").partitionBy("file", "sheet").format(fmt).save(path))
