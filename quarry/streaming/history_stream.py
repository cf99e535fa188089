"""X2 stream_history: per-conversation buffer of the last 12 turns.

The buffer is keyed state (``applyInPandasWithState``): a conversation's newest
``keep`` turns and nothing else, held by Spark's state store. A micro-batch
reads, changes and writes out the conversations that it touches, whatever the
number of others; new turns of a conversation stream past its state in Arrow
batches, so a task holds ``keep`` turns of one conversation.

Each batch's changed buffers are one folder ``epoch=<n>`` below a folder named
after the stream's checkpoint. A batch that runs again after a fault overwrites
its own folder. The newest rows of a conversation are its buffer; ``fold`` writes
all buffers as a snapshot, after which older folders are not read any more and
may be deleted. Equals the rolling window W6 at the end of the stream.

Of several rows for one turn the first that arrived counts, within a batch the
least by role and text; a null turn is older than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import read_if_there

KEEP = 12
COLS = ["conv_id", "turn", "role", "text"]
ROWS = "conv_id long, turn long, role string, text string"
STATE = "turn array<long>, role array<string>, text array<string>"
_FIRST = -(1 << 63)  # a null turn's place


def _none(x):
    return None if pd.isna(x) else x


def update_buffer(keep: int):
    """State function: key, its new rows, state -> the key's buffer."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            held = {(_FIRST if t is None else t): (r, x) for t, r, x in zip(*state.get)}
        for pdf in batches:
            new = {}
            for t, r, x in zip(pdf["turn"], pdf["role"], pdf["text"]):
                t, value = _FIRST if pd.isna(t) else int(t), (_none(r), _none(x))
                if t not in held and (t not in new or _order(value) < _order(new[t])):
                    new[t] = value
            held = dict(sorted([*held.items(), *new.items()], key=lambda kv: kv[0], reverse=True)[:keep])
        turns = [None if t == _FIRST else t for t in held]
        state.update((turns, [r for r, _ in held.values()], [x for _, x in held.values()]))
        yield pd.DataFrame({"conv_id": pd.array([key[0]] * len(held), "Int64"), "turn": pd.array(turns, "Int64"),
                            "role": [r for r, _ in held.values()], "text": [x for _, x in held.values()]})
    return run


def _order(value: tuple) -> tuple:
    return tuple((x is not None, x or "") for x in value)


def _folder(root: str, checkpoint: str) -> str:
    return f"{root}/{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"


def stream_history(spark: SparkSession, src: str, schema: str, root: str, checkpoint: str,
                   keep: int = KEEP, files: int = 1) -> DataFrame:
    """Take in what is available in the folder ``src``, ``files`` files a batch, and
    return the buffers. The same checkpoint goes on where it stopped."""
    folder = _folder(root, checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/epoch={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(src).select(*COLS)
    buffers = stream.groupBy("conv_id").applyInPandasWithState(update_buffer(keep), ROWS, STATE, "update", "NoTimeout")
    q = (buffers.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return history(spark, root, checkpoint)


def _newest(spark: SparkSession, root: str, checkpoint: str) -> tuple[DataFrame, int]:
    """Rows with the epoch of their conversation's newest buffer, and the newest epoch."""
    folder = _folder(root, checkpoint)
    empty = spark.createDataFrame([], f"{ROWS}, epoch long")
    folded = read_if_there(spark, f"{folder}/snapshots")
    after, old = -1, empty
    if folded is not None:
        after = folded.agg(F.max("upto")).first()[0]  # a folder value: no data is read
        old = folded.where(F.col("upto") == after).select(*COLS, F.col("epoch").cast("long"))
    updates = read_if_there(spark, f"{folder}/updates")
    new = empty if updates is None else updates.where(F.col("epoch") > after).select(*COLS, F.col("epoch").cast("long"))
    rows = old.unionByName(new)
    newest = F.max("epoch").over(Window.partitionBy("conv_id"))
    upto = after if updates is None else max(after, updates.agg(F.max("epoch")).first()[0])
    return rows.withColumn("_n", newest).where("epoch = _n").drop("_n"), upto


def history(spark: SparkSession, root: str, checkpoint: str) -> DataFrame:
    """The buffers: the newest turns of every conversation."""
    return _newest(spark, root, checkpoint)[0].select(*COLS)


def fold(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Write all buffers as one snapshot; what is older is not read again."""
    rows, upto = _newest(spark, root, checkpoint)
    if upto >= 0:
        rows.write.mode("overwrite").parquet(f"{_folder(root, checkpoint)}/snapshots/upto={upto}")
