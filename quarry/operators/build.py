"""R1 build_corpus: load -> chunk -> fingerprint -> dedup -> embed -> write.

The corpus table is Parquet partitioned by ``session_id``; its ``(session_id,
fp)`` columns are the dedup ledger, so re-running on the same input adds
nothing. The anti-join runs before the embedding step, so vectors are only
computed for new chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import corpus as C
from quarry.operators.infer import embed_chunks
from quarry.session import read_if_there, scratch_path

CORPUS_COLS = ["chunk_id", "doc_id", "source", "pos", "text", "fp", "embedding", "session_id"]


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    table = read_if_there(spark, path)
    return None if table is None else table.select("session_id", "fp")


def build_corpus(spark: SparkSession, docs: DataFrame, path: str, recursive: bool = False,
                 embed=None) -> DataFrame:
    """Append the unseen chunks of ``docs`` to the corpus at ``path``;
    returns the rows that were added (read back from the written table)."""
    if docs.limit(1).count() == 0:
        raise ValueError("no documents to index")
    chunks = C.chunk_recursive(docs) if recursive else C.chunk_fixed(docs)
    chunks = C.fingerprint(chunks)
    ledger = _existing(spark, path)
    if ledger is None:
        ledger = spark.createDataFrame([], "session_id string, fp string")
    staged = scratch_path(spark, "new-chunks")
    new = C.add_to_corpus(chunks, ledger, staged=scratch_path(spark, "new-ids"))
    new.write.parquet(staged)  # compressed, unlike a checkpoint; embed sees only new rows
    new = spark.read.schema(new.schema).parquet(staged)
    if not new.isEmpty():
        # vectors are mostly zeros, which zstd packs to about half of what snappy does
        embed_chunks(new, embed=embed).select(*CORPUS_COLS).write.mode("append") \
            .option("compression", "zstd").partitionBy("session_id").parquet(path)
    return new.select("session_id", "chunk_id", "fp")
