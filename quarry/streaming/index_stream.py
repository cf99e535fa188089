"""X1 stream_index: new files -> chunks -> only unseen fingerprints.

``readStream`` over a folder of text files, ``foreachBatch`` runs the batch
dedup (J1) against the corpus table and appends; ``trigger(availableNow)``
processes what is there and stops. Replaying the same files adds nothing,
and the checkpoint makes a restarted query resume where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.session import read_if_there


def _batch_writer(corpus_path: str, session_id: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        docs = batch.select(F.abs(F.xxhash64("path")).alias("doc_id"), F.col("path").alias("source"),
                            F.lit(session_id).alias("session_id"), F.col("value").alias("text"))
        chunks = C.fingerprint(C.chunk_fixed(docs))
        ledger = read_if_there(spark, corpus_path)
        if ledger is None:
            ledger = spark.createDataFrame([], "session_id string, fp string")
        # the session is a partition of the table: other sessions' files are not read
        ledger = ledger.where(F.col("session_id") == session_id).select("session_id", "fp")
        new = C.add_to_corpus(chunks, ledger)
        new.write.mode("append").partitionBy("session_id").parquet(corpus_path)
    return write


def stream_index(spark: SparkSession, src: str, corpus_path: str, checkpoint: str,
                 session_id: str = "stream") -> None:
    """Run the indexing stream once over everything available in ``src``."""
    stream = (spark.readStream.format("text").option("wholetext", True)
              .option("recursiveFileLookup", True).load(src)
              .select(F.col("_metadata.file_path").alias("path"), "value"))
    q = (stream.writeStream.foreachBatch(_batch_writer(corpus_path, session_id))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
