"""Approximate nearest neighbours with sign-bit LSH.

A table's code of a vector is the signs of its products with ``bits`` random
directions, so vectors at a small angle share it often. A question looks up, in
every table, its own code and the codes that differ in one bit (multi-probe);
the items found are ranked by exact distance, within the bucket. Nothing is
truncated, whatever a bucket's size: a task holds the questions of one bucket and
streams its items past them; buckets are made smaller with more bits.

How much is pruned depends on the data. Independent random directions, such as
the test vectors, have no near neighbours to speak of: 0.9 recall takes about
half of all pairs as candidates there, by any choice of bits and tables tried.
Vectors in clusters need a few percent (tests/test_limits.py).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import retrieve as R


def _dist(a, b):
    return F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) *
                                                 (x.cast("double") - y.cast("double"))),
                                      F.lit(0.0), lambda acc, v: acc + v)), 6)


def sign_codes(vec, bits: int, n_tables: int, seed: int):
    """Array of one code per table. The directions follow from the seed and the
    vector's length; a null or empty vector has no codes."""
    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        for size, part in v.dropna().groupby(v.dropna().map(len)):
            if size:
                planes = np.random.default_rng(seed).standard_normal((size, n_tables * bits))
                signs = (np.array(part.tolist(), float) @ planes > 0).reshape(len(part), n_tables, bits)
                out[part.index] = pd.Series(list((signs << np.arange(bits)).sum(2).astype(np.int32)), part.index)
        return out
    return codes(vec)


def candidates(queries: DataFrame, items: DataFrame, bits: int, n_tables: int, seed: int, qid: str, item_id: str,
               vec: str) -> DataFrame:
    """(qid, item_id): the different pairs that share a probed bucket."""
    ib = items.select(item_id, F.posexplode(sign_codes(F.col(vec), bits, n_tables, seed)).alias("t", "code"))
    qb = queries.select(qid, F.posexplode(sign_codes(F.col(vec), bits, n_tables, seed)).alias("t", "own"))
    masks = [F.lit(0)] + [F.lit(1 << i) for i in range(bits)]
    probes = qb.select(qid, "t", F.explode(F.array(*[F.col("own").bitwiseXOR(m) for m in masks])).alias("code"))
    return probes.join(ib, ["t", "code"]).select(qid, item_id).distinct()


def knn_lsh(queries: DataFrame, items: DataFrame, k: int, *, bits: int = 8, n_tables: int = 26, seed: int = 7,
            qid: str = "qid", item_id: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """(qid, item_id, dist): the ``k`` nearest candidates of each question; ties
    go to the smaller id. Use more bits for more items and more tables for recall."""
    ib = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("_i"), F.col(vec).alias("_v"), F.posexplode(sign_codes(F.col(vec), bits, n_tables, seed)).alias("t", "code"))
    qb = queries.where(F.col(qid).isNotNull()).select(
        F.col(qid).alias("_q"), F.col(vec).alias("_v"), F.posexplode(sign_codes(F.col(vec), bits, n_tables, seed)).alias("t", "own"))
    masks = [F.lit(0)] + [F.lit(1 << i) for i in range(bits)]
    probes = qb.select("_q", "_v", "t", F.explode(F.array(*[F.col("own").bitwiseXOR(m) for m in masks])).alias("code"))
    bucket, none = F.concat_ws(":", "t", "code").alias("_c"), F.lit(None)
    met = probes.select(bucket, F.lit(False).alias("_item"), "_q", none.cast(items.schema[item_id].dataType).alias("_i"), none.cast("int").alias("_g"), "_v").unionByName(
        ib.select(bucket, F.lit(True).alias("_item"), none.cast(queries.schema[qid].dataType).alias("_q"), "_i", none.cast("int").alias("_g"), "_v"))
    # a bucket's questions see its items in one task and keep the k nearest: candidate pairs are never shuffled
    out = T.StructType([T.StructField("qid", queries.schema[qid].dataType), T.StructField(item_id, items.schema[item_id].dataType),
                        T.StructField("dist", T.DoubleType())])
    near = met.repartition("_c").sortWithinPartitions("_c", "_item").mapInArrow(R._knn_cells(k, item_id, None, 2048), out)
    near = near.distinct()
    for df, key, name in ((queries, qid, "qid"), (items, item_id, item_id)):  # ids that are there n times come out n times
        times = df.where(F.col(vec).isNotNull()).groupBy(F.col(key).alias(name)).agg((F.count(F.lit(1)) / F.count_distinct(vec)).cast("int").alias("_n")).where("_n > 1")
        if not times.isEmpty():
            near = near.join(times, name, "left").select("qid", item_id, "dist", F.explode(
                F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))).alias("_n")).drop("_n")
    best = R.top_k(near, k, ["qid"], [F.col("dist"), F.col(item_id)], "_r").drop("_r")
    return best.withColumnRenamed("qid", qid) if qid != "qid" else best
