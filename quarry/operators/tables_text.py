"""Text dumps of tables for the corpus (name, columns, first rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import ledger as L
from quarry.operators.retrieve import top_k

MAX_ROWS = 1000


def dump_tables(cells: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One text per (file, sheet): ``file::sheet``, ``# Columns: a, b`` and
    the first ``max_rows`` body rows tab-joined. The row cap is the feature
    (a dump is a preview); the per-sheet top-k runs as a partial limit
    before the shuffle."""
    h = L.detect_header(cells)
    names = L.column_names(cells, h).groupBy(*L.SHEET).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "name"))), lambda s: s["name"]),
                     ", ").alias("cols"))
    body = top_k(L.body(cells, h), max_rows, L.SHEET, [F.col("row_idx")], "_r")
    lines = body.groupBy(*L.SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("row_idx", X.linearize(F.col("cells"), "\t").alias("l")))), lambda s: s["l"]), "\n").alias("rows"))
    return names.join(lines, L.SHEET, "left").select(
        *L.SHEET, F.concat(F.col("file"), F.lit("::"), F.col("sheet"), F.lit("\n# Columns: "), F.col("cols"),
                           F.lit("\n"), F.coalesce(F.col("rows"), F.lit(""))).alias("text"))
