"""Helpers shared by the training-data operators.

A *word* is a maximal run of characters other than blank, tab, line feed,
vertical tab, form feed and carriage return. In Python, ``bytes.split()`` cuts
at exactly these bytes and ``bytes.lower()`` touches A-Z only.
"""

from __future__ import annotations

import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
NULL_ID = -(1 << 63)  # stands for a null id while rows are compared: sorts first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once per row: a lambda variable is not
    inlined again by the optimizer, as a column of an earlier select may be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_col(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words_col(text: Column) -> Column:
    return F.size(words_col(text)).cast("long")


def ascii_lower_col(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: lineage ends there, and a lost executor costs one read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_hashes(words: list) -> np.ndarray:
    """64-bit hash of each word (hashing again is faster than looking it up)."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): spreads sums and products over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode()


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, null as an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def restored(keys: DataFrame, docs: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, all columns, whose id (null ids included) and digest are
    in ``keys`` (doc_id, digest, and maybe ``single``). Where a key says single and
    several rows have it, the one that sorts first as JSON stands for them. Any
    other column may clash with the keys'."""
    rows = docs.select(F.col(id_col).alias("_id"), digest.alias("_digest"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))

    def found(some: DataFrame) -> DataFrame:
        k = some.select(F.col("doc_id").alias("_k"), F.col("digest").alias("_d"))
        return rows.join(k, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left_semi")

    if "single" not in keys.columns:
        return found(keys).select("_row.*")
    out = found(keys.where("not single"))
    if not keys.where("single").isEmpty():
        out = out.unionByName(found(keys.where("single")).groupBy("_id", "_digest").agg(
            F.min_by("_row", F.to_json("_row")).alias("_row")))
    return out.select("_row.*")
