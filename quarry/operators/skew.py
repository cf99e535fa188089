"""Skew-safe running computations over very large groups.

A plain ``row_number().over(partitionBy(k).orderBy(o))`` puts a whole key in
one task. When one key (a file, a sheet) may hold a third of all rows, we
instead cut the key into fixed-width blocks of the order column, compute the
per-block result in parallel, and stitch blocks together through a small
per-block summary table (prefix sums / last value). The block width is a
parameter; since ``order`` is unique within a key, no block holds more than
``width`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _blocked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(order) / F.lit(width)))


def ordinal(df: DataFrame, part: list[str], order: str, out: str = "ordinal",
            width: int = BLOCK) -> DataFrame:
    """1-based position of each row within ``part`` ordered by ``order``
    (``order`` numeric and unique within ``part``)."""
    b = _blocked(df, order, width)
    counts = b.groupBy(*part, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = (Window.partitionBy(*part).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_prev), F.lit(0))).drop("_n")
    w_loc = Window.partitionBy(*part, "_blk").orderBy(order)
    return (b.join(offs, part + ["_blk"])
            .withColumn(out, (F.col("_off") + F.row_number().over(w_loc)).cast("long"))
            .drop("_blk", "_off"))


def prefix_sum(df: DataFrame, part: list[str], order: str, value: str, out: str,
               width: int = BLOCK) -> DataFrame:
    """Running sum of ``value`` (inclusive) within ``part`` by ``order``."""
    b = _blocked(df, order, width)
    sums = b.groupBy(*part, "_blk").agg(F.sum(value).alias("_s"))
    w_prev = (Window.partitionBy(*part).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = sums.withColumn("_off", F.coalesce(F.sum("_s").over(w_prev), F.lit(0))).drop("_s")
    w_loc = (Window.partitionBy(*part, "_blk").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, 0))
    return (b.join(offs, part + ["_blk"])
            .withColumn(out, F.col("_off") + F.sum(value).over(w_loc))
            .drop("_blk", "_off"))


def carry_forward(df: DataFrame, part: list[str], order: str, value: str, out: str,
                  width: int = BLOCK) -> DataFrame:
    """Last non-NULL ``value`` at or before each row within ``part``
    (gaps-and-islands: the island a row belongs to)."""
    b = _blocked(df, order, width)
    # one aggregation gives every block and its last non-NULL value (NULL
    # order keys are ignored by max_by)
    blocks = b.groupBy(*part, "_blk").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    w_prev = (Window.partitionBy(*part).orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = blocks.withColumn("_carry", F.last("_last", ignorenulls=True).over(w_prev)) \
                  .drop("_last")
    w_loc = (Window.partitionBy(*part, "_blk").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, 0))
    return (b.join(carry, part + ["_blk"])
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w_loc), F.col("_carry")))
            .drop("_blk", "_carry"))
