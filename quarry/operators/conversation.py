"""Chat memory over ``conversations(conv_id, turn, role, text)``.

The rolling history is a bounded sliding frame (12 rows) per conversation,
so each output row reads a constant number of input rows. A conversation is cut
into blocks of ``BLOCK`` turns; the last 12 turns of a block are also read with
the next one, so a conversation of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import skew

HISTORY_TURNS = 12
BLOCK = 1 << 12  # turns of a conversation in one window partition


def with_halo(conv: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """``conv`` with ``_conv`` and ``_block``, in which windows of ``n`` earlier
    turns lie whole: a block's last ``n`` turns come again, with ``_own`` false, in
    the next block. A null conversation is one of its own; a null turn comes first."""
    rows = conv.withColumn("_conv", F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))) \
               .withColumn("_turn", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))))
    rows = skew.ordinal(rows, ["_conv"], "_turn", "_at", width=max(block, n))
    width = F.lit(max(block, n))
    own = F.floor((F.col("_at") - 1) / width).cast("long")
    blocks = F.when(F.pmod(F.col("_at") - 1, width) >= width - n, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def _w(n: int):
    return Window.partitionBy("_conv", "_block").orderBy("_at").rowsBetween(-n, -1)


def _own(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_conv", "_turn", "_at", "_block", "_own")


def rolling_history(conv: DataFrame, n: int = HISTORY_TURNS, block: int = BLOCK) -> DataFrame:
    """For every turn, the previous ``n`` turns as ``User: ..`` /
    ``Assistant: ..`` lines (any non-user role is the assistant), blanks
    dropped after taking the window."""
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.struct(F.col("_at"), F.concat(who, F.lit(": "), X.strip(F.col("text"))).alias("l"),
                    (F.coalesce(X.strip(F.col("text")), F.lit("")) != "").alias("ok"))
    hist = F.array_sort(F.collect_list(line).over(_w(n)))
    kept = F.filter(hist, lambda s: s["ok"])
    return _own(with_halo(conv, n, block).withColumn("history", F.array_join(F.transform(kept, lambda s: s["l"]), "\n"))
                .withColumn("n_history", F.size(kept)))


def contextualize(conv: DataFrame, n: int = HISTORY_TURNS, block: int = BLOCK) -> DataFrame:
    """R4 default rewrite: a user turn with history becomes the last earlier
    user turn (stripped) + a space + the turn; no usable history -> the turn
    unchanged. A pluggable ``rewrite`` hook replaces this expression."""
    prev_user = F.last(F.when((F.col("role") == "user") & (X.strip(F.col("text")) != ""),
                              X.strip(F.col("text"))), ignorenulls=True).over(_w(n))
    return _own(with_halo(conv, n, block).withColumn("standalone", F.when(
        prev_user.isNotNull(), F.concat(prev_user, F.lit(" "), F.col("text"))).otherwise(F.col("text"))))


def raw_history(conv: DataFrame, n: int = HISTORY_TURNS, block: int = BLOCK) -> DataFrame:
    """``conv`` with ``raw``: the JSON list of the previous ``n`` turns that a request carries."""
    items = F.collect_list(F.struct(F.col("role"), F.col("text").alias("content"))).over(_w(n))
    return _own(with_halo(conv, n, block).withColumn("raw", F.to_json(items)))


HISTORY_SCHEMA = "array<struct<role:string,content:string>>"


def parse_history(raw) -> "F.Column":
    """JSON list of {role, content}; items without content dropped;
    last 12 kept; unparseable -> empty list."""
    items = F.coalesce(F.from_json(raw, HISTORY_SCHEMA), F.array().cast(HISTORY_SCHEMA))
    kept = F.filter(items, lambda x: x.isNotNull() & (F.coalesce(X.strip(x["content"]), F.lit("")) != ""))
    return F.when(F.size(kept) > HISTORY_TURNS, F.slice(kept, -HISTORY_TURNS, HISTORY_TURNS)).otherwise(kept)
