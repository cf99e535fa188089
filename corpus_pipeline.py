"""Training-corpus pipeline: five stages, each one operator of ``quarry.llm``.

``run`` writes the rows of each stage as Parquet under the shared checkpoint
folder and reads them back as the next stage's documents.

A stage decides on rows, not ids: its decisions go back to the rows by id and
digest of the text, so rows that share an id, or have none, do not share a fate.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, qda, simhash, viterbi_pieces
from quarry.llm.common import ascii_lower_col, restored, stage, table, text_digest
from quarry.llm.queries import TOKENIZERS
from quarry.session import ensure_checkpoint_dir, ship_package


def stage_of(fn):
    """Workers can import the package, whoever calls the stage."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@stage_of
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (predicted 1)."""
    digest = text_digest(F.col("text"))
    scores = qda.quality_scores(docs, table(spark, sf_dir, "labels"), digest=digest)
    return restored(scores.where("predicted = 1"), docs, digest)


@stage_of
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts, one row of it."""
    keys = exact_dedup.exact_groups(docs).where("kept").groupBy("doc_id", "digest").agg((F.count(F.lit(1)) > 1).alias("single"))
    return restored(stage(keys, "exact-keys"), docs, text_digest(ascii_lower_col(F.col("text"))))


@stage_of
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of several
    rows with that id, or of a group without ids, the one with the least digest."""
    digest = text_digest(F.col("text"))
    least = simhash.simhash_groups(docs, digest=digest).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = least.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"), (F.count(F.lit(1)) > 1).alias("single"))
    return restored(stage(keys, "near-keys"), docs, digest)


@stage_of
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from never to three times. An
    id of its own has the hash of ``mixing``; texts that share an id or have none
    are hashed with their digest (equal ones share a hash: exact dedup leaves one)."""
    shared = stage(docs.groupBy(F.col("doc_id").alias("_i")).count().where("_i is not null and count > 1").select("_i"), "mix-shared")
    rows = docs.select("doc_id", "text", "source", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")).join(
        shared, F.col("doc_id") == F.col("_i"), "left")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    own = F.col("doc_id").isNotNull() & F.col("_i").isNull()
    rows = rows.select("text", "source", "_row", F.when(own, name).otherwise(
        F.concat_ws(":", name, F.sha2(F.coalesce("text", F.lit("")), 256))).alias("_key"))
    plan = mixing.mix_documents(rows, "_key").where("copies > 0").select(
        F.col("doc_id").alias("_k"), F.col("source").alias("_s"), "copies").distinct()
    taken = rows.join(plan, (F.col("_key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")


@stage_of
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row."""
    return viterbi_pieces.encode_texts(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("mix_sources", mix), ("sentencepiece", pieces)]

#: The classifier's scores cannot be expressed in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
