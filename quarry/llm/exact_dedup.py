"""Exact deduplication by skew-safe combining.

Three aggregations on (digest, full normalised text), each able to combine on
the map side: rows are first deduplicated in their own task, then merged by
digest and a salt taken from the task, then the salt winners are combined
globally. The text itself is part of every grouping key, so equality of content
is decided by content and never by the digest alone. Built-in functions only.

Defined results: a null text counts as empty; texts are equal when identical
after lower-casing A-Z; the largest doc_id of equal texts stays, and null ids
lose to any other (of a group with null ids only, each row is kept); rows that
repeat the winner's doc_id share its verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower_col, stage

SALTS = 16


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _normal(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    norm = ascii_lower_col(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", digest(F.col("norm")).alias("digest"))


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row per different text.

    A task sends one row per text it holds, and a hot text's rows from all tasks
    are merged by ``salts`` tasks before one task sees ``salts`` rows of it."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("k"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "norm").agg(F.max("k").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                 digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of ``docs``.

    Where a digest stands for one text, as all do unless SHA-256 collides, the
    rows find their group by digest, and the texts need not move again; rows of
    any other digest are matched by digest and text."""
    rows = _normal(docs, id_col, text_col, digest)
    groups = combined(rows, salts)
    by_digest = stage(groups.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")),
        "exact-groups")
    shared = by_digest.where("texts > 1").select("digest")
    out = rows.select("doc_id", "digest").join(by_digest.where("texts = 1").drop("texts"), "digest")
    if not shared.isEmpty():
        mixed = rows.join(shared, "digest", "left_semi")
        out = out.unionByName(mixed.join(combined(mixed, salts), ["digest", "norm"]).drop("norm"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
