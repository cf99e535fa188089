"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the running sums show in which
bucket a source's budget ends, and only that boundary bucket is cut into finer
buckets, until one hash value is left. A document is then taken by comparing its
hash with its source's threshold: nothing is sorted, and a smaller budget takes
a subset of a larger one.

A target above the source's size takes every document whole times and the rest
by threshold. Defined results: a null text has size 0; a null source is a source
of its own, last in order; documents with equal ids share a hash and so their
fate, documents without an id if their texts are equal (a null text as an empty
one); the document at the threshold is taken if that brings the sum nearer to
the target. Documents of size 0 are taken like any other hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import n_words_col, stage

HASH_BITS = 60
LEVEL_BITS = 12         # of the hash, for each refinement: 4096 buckets a source at once
MAX_REPEAT = 3


def unit_hash(id_value: Column, text: Column, seed: str = "mix") -> Column:
    """The first 60 bits of an MD5 of the id, or of the text's digest where there is
    none: reruns and other engines agree."""
    named = F.coalesce(id_value.cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    key = F.concat(F.lit(seed + ":"), named)
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``at``, their 0-based rank by code point, nulls last:
    dealt out by range, ranked in each range, and moved on by the counts of the
    ranges before (one row per partition)."""
    dealt = stage(sources.withColumn("last", F.col("source").isNull().cast("int"))
                  .repartitionByRange("last", "source").withColumn("range", F.spark_partition_id()), "mix-sources")
    w = Window.partitionBy("range").orderBy("last", "source")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return dealt.withColumn("k", F.row_number().over(w) - 1).join(counts, "range").select(
        "source", "source_size", (F.col("k") + F.col("off")).alias("at"))


def targets(sources: DataFrame, weights: tuple = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target). Every source gets weight x level, at most
    ``max_repeat`` times its size; the level is raised until the whole size is
    handed out. Each round is one sum over the sources, of which two numbers
    come back; sources only ever join the capped ones, so the rounds end."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    s = stage(ranked(sources).withColumn("weight", weight.cast("long")), "mix-ranked")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * max_repeat
        n, taken, open_weight = s.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size") * max_repeat).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, float(total - taken) / float(open_weight)
    share = F.least((F.col("source_size") * max_repeat).cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return s.select("source", "source_size", share.alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, cut): every document is taken
    ``copies`` times, and once more if its hash is below ``cut``.

    Each round sums the sizes of the boundary bucket of every source in 4096
    finer buckets (combined on the map side: at most 4096 rows a source leave a
    task) and moves to the bucket in which the budget ends. The result is written,
    so that its size is known when the documents are joined with it: the planner
    broadcasts it up to spark.sql.autoBroadcastJoinThreshold, and no source's
    documents meet in one task then."""
    state = stage(plan.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies")
    ).select("*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"),
             F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below")), "mix-state")
    left = HASH_BITS
    while left > 0:
        width = 1 << (left - LEVEL_BITS)
        s = state.alias("s")
        boundary = sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (
            F.col("d.hash") >= F.col("s.low")) & (F.col("d.hash") < F.col("s.low") + F.lit(width << LEVEL_BITS)))
        hist = boundary.groupBy("s.source", F.shiftright(F.col("d.hash") - F.col("s.low"), left - LEVEL_BITS).alias("b")) \
            .agg(F.sum("d.size").alias("n"))
        run = Window.partitionBy("source").orderBy("b")
        h = hist.withColumn("upto", F.sum("n").over(run)).alias("h")
        # the first bucket whose running sum passes the budget; none: the budget ends above them all
        ends = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(
            F.min(F.when(F.col("s.below") + F.col("h.upto") > F.col("s.budget"), F.struct("h.b", "h.upto", "h.n"))).alias("e"),
            F.max("h.upto").alias("all")).alias("x")
        moved = s.join(ends, F.col("s.source").eqNullSafe(F.col("x.source")), "left")
        state = stage(moved.select(
            "s.source", "s.source_size", "s.target", "s.copies", "s.budget",
            F.when(F.col("x.source").isNull() & F.col("x.all").isNull(), F.col("s.low"))
            .otherwise(F.col("s.low") + F.coalesce(F.col("x.e.b"), F.lit((1 << LEVEL_BITS) - 1)) * F.lit(width)).alias("low"),
            F.when(F.col("x.e").isNotNull(), F.col("s.below") + F.col("x.e.upto") - F.col("x.e.n"))
            .otherwise(F.col("s.below")).alias("below")), "mix-state")
        left -= LEVEL_BITS
    s = state.alias("s")
    at = sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.hash") == F.col("s.low"))) \
        .groupBy("s.source").agg(F.sum("d.size").alias("n")).alias("x")
    over = F.col("s.below") + F.coalesce(F.col("x.n"), F.lit(0)) - F.col("s.budget")
    nearer = over < F.col("s.budget") - F.col("s.below")
    return stage(s.join(at, F.col("s.source").eqNullSafe(F.col("x.source")), "left").select(
        "s.source", "s.source_size", "s.target", "s.copies", (F.col("s.low") + nearer.cast("long")).alias("cut")), "mix-cuts")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple = (1, 2, 3), max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of
    ``docs``; ``copies`` says how often the mix takes the document."""
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              n_words_col(F.col(text_col)).alias("size"),
                              unit_hash(F.col(id_col), F.col(text_col), seed).alias("hash")), "mix-sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = thresholds(sized, targets(sources, weights, max_repeat)).alias("c")
    d = sized.alias("d")
    return d.join(cuts, F.col("d.source").eqNullSafe(F.col("c.source"))).select(
        "d.doc_id", "d.source", "d.size", "c.source_size", "c.target",
        F.least(F.lit(max_repeat), F.col("c.copies") + (F.col("d.hash") < F.col("c.cut")).cast("long")).alias("copies"))
