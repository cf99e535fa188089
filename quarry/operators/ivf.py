"""Nearest neighbours over a partition of the space that follows the data.

*Build.* Centres are fitted on a bounded sample (``sample_rows`` rows, chosen by
the hash of their id); every item belongs to the list of its nearest centre and
keeps a code of its *residual*, its difference from that centre: the residual is
cut into parts and each part is replaced by the nearest of 256 words, also fitted
on the sample. A code has one byte a part. Two tables are written: ``codes``
(list, shard, id, code), where a list of over ``SHARD`` items is cut into shards by
the id's hash, and ``vectors``, bucketed and sorted by id.

*Search.* A question probes its nearest lists. Its distances to their items are
sums of looked-up distances to code words; the ``rerank`` best of these meet their
vectors, in a join without a shuffle of the vectors, for the exact distance.

*Fallback.* How many lists are probed is measured at build time: the fewest that
hold ``recall`` of the true neighbours among the sampled rows (of which a sample of
one row in eight has one for eight of the whole table). If that takes more than ``max_share`` of all items the vectors have no structure to follow (independent
random directions have none), and ``knn`` is the exact grid search instead.

Ids are unique. Rows without a vector (null or empty) take no part; a vector of
another length than the rest is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import retrieve as R
from quarry.operators.lsh import _dist
from quarry.operators.postings import _bucketed
from quarry.session import scratch_path

SAMPLE_ROWS = 20_000
MAX_LISTS = 4096  # so the centres, which go to every task, stay small
SHARD = 1 << 16  # items in a shard of a list, about
WORDS = 256
BLOCK = 512  # questions that a task holds at once
ASKED = 256  # sampled rows that are asked to choose the number of probes


def _matrix(rows: list, size: int | None = None) -> np.ndarray:
    sizes = {len(r) for r in rows} | ({size} if size else set())
    if len(sizes) > 1:
        raise ValueError(f"vectors of one index have one length, not {sorted(sizes)}")
    return np.array(rows, float)


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    """Index of the nearest centre of each row; the first of equal ones."""
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmin(half - x[i:i + step] @ centres.T, 1) for i in range(0, len(x), step)] or [np.empty(0, int)])


def _centres(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Up to ``n`` means of ``x``. An empty one moves to the row that is farthest
    from its own mean."""
    x = np.unique(x, axis=0)
    at = np.random.default_rng(seed).permutation(len(x))[:n]
    c = x[np.sort(at)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        none = np.flatnonzero(size == 0)
        if len(none):
            far = np.argsort(-((x - c[own]) ** 2).sum(1), kind="stable")[:len(none)]
            c[none[:len(far)]] = x[far]
    return c


@dataclass
class Partition:
    """What is fitted on the sample: centres, code words and the probes it takes."""

    centres: np.ndarray
    books: list = field(repr=False)
    n_probe: int
    share: float  # of all items, in the probed lists of a question

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each row."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([_nearest(p, b) for p, b in zip(self.parts(rest), self.books, strict=True)], 1).astype(np.uint8)

    def probes(self, x: np.ndarray) -> np.ndarray:
        d = (self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)
        return np.argsort(d, axis=1, kind="stable")[:, :self.n_probe]

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """(question, part, word): squared distances to the words of list ``at``."""
        out = np.zeros((len(q), len(self.books), WORDS), np.float32)
        for j, (p, b) in enumerate(zip(self.parts(q - self.centres[at]), self.books, strict=True)):
            out[:, j, :len(b)] = ((p[:, None] - b[None]) ** 2).sum(2)
        return out


def fit(x: np.ndarray, n_lists: int, seed: int = 7, code_bytes: int | None = None, recall: float = 0.97, near: int = 10) -> Partition:
    """Partition of the sampled rows ``x``, and the probes that find ``recall`` of
    the ``near`` nearest sampled rows of ``ASKED`` of them."""
    centres = _centres(x, n_lists, seed)
    own = _nearest(x, centres)
    rest = x - centres[own]
    books = [_centres(p, WORDS, seed, 6) for p in np.array_split(rest, code_bytes or max(1, x.shape[1] // 4), axis=1)]
    asked = np.random.default_rng(seed).permutation(len(x))[:ASKED]
    d = (x * x).sum(1) - 2 * (x[asked] @ x.T)
    d[np.arange(len(asked)), asked] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :max(1, min(near, len(x) - 1))]
    order = np.argsort((centres * centres).sum(1) - 2 * (x[asked] @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list in a question's order
    found = np.bincount(np.take_along_axis(place, own[best], 1).ravel(), minlength=len(centres)).cumsum() / best.size
    n_probe = min(int(np.searchsorted(found, recall)) + 1, len(centres))
    size = np.bincount(own, minlength=len(centres)) / len(x)
    return Partition(centres, books, n_probe, float(size[order[:, :n_probe]].sum(1).mean()))


@dataclass
class VectorIndex:
    partition: Partition | None  # None: there is no vector
    lists: DataFrame | None  # (list, shards)
    codes: DataFrame | None  # (list, shard, item, code)
    vectors: DataFrame  # (item, vector), bucketed by item
    item_id: str
    vec: str
    structured: bool


def build_index(items: DataFrame, *, item_id: str = "chunk_id", vec: str = "embedding", n_lists: int | None = None,
                sample_rows: int = SAMPLE_ROWS, code_bytes: int | None = None, recall: float = 0.97, max_share: float = 0.25,
                near: int = 10, shard: int = SHARD, buckets: int | None = None, seed: int = 7) -> VectorIndex:
    """Fit on a sample, write every item. ``n_lists`` is the root of the number of
    items by default, ``MAX_LISTS`` at most; the probes are chosen for questions
    that ask for ``near`` neighbours. Without structure no codes are written."""
    spark = items.sparkSession
    rows = items.where(F.size(vec) > 0).select(item_id, vec)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = _bucketed(rows, [item_id], buckets, scratch_path(spark, "ivf-vectors"))
    n = vectors.count()
    if not n:
        return VectorIndex(None, None, None, vectors, item_id, vec, False)
    cut = min(1.0, sample_rows / n)
    drawn = vectors.where(F.pmod(F.xxhash64(item_id, F.lit(seed)), F.lit(1 << 30)) <= int(cut * (1 << 30))).orderBy(item_id)
    x = _matrix([r[0] for r in drawn.select(vec).limit(2 * sample_rows).collect()])
    if not len(x):
        x = _matrix([r[0] for r in vectors.select(vec).limit(1).collect()])
    part = fit(x, n_lists or min(MAX_LISTS, int(np.ceil(np.sqrt(n)))), seed, code_bytes, recall, max(1, round(near * cut)))
    if part.share > max_share:
        return VectorIndex(part, None, None, vectors, item_id, vec, False)
    sent = spark.sparkContext.broadcast(part)  # MAX_LISTS centres and 256 words, whatever the input

    def encode(batches):
        for b in batches:
            if b.num_rows:
                own, code = sent.value.encode(_matrix(b.column(1).to_pylist(), sent.value.centres.shape[1]))
                yield pa.record_batch([pa.array(own, pa.int32()), b.column(0), pa.array([c.tobytes() for c in code], pa.binary())],
                                      ["list", item_id, "code"])

    schema = T.StructType([T.StructField("list", T.IntegerType()), rows.schema[item_id], T.StructField("code", T.BinaryType())])
    flat, path = scratch_path(spark, "ivf-flat"), scratch_path(spark, "ivf-codes")
    vectors.mapInArrow(encode, schema).write.parquet(flat)
    coded = spark.read.schema(schema).parquet(flat)
    lists = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    lists.write.parquet(path + "-lists")
    lists = spark.read.parquet(path + "-lists")
    codes = coded.join(lists, "list").select("list", F.pmod(F.xxhash64(item_id), "shards").cast("int").alias("shard"), item_id, "code")
    codes.write.parquet(path)
    return VectorIndex(part, lists, spark.read.parquet(path), vectors, item_id, vec, True)


def probed(questions: DataFrame, index: VectorIndex, qid: str = "qid", qvec: str = "embedding") -> DataFrame:
    """(qid, list, vector): the lists that each question looks into."""
    sent = questions.sparkSession.sparkContext.broadcast(index.partition)

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = sent.value.probes(_matrix(b.column(1).to_pylist(), sent.value.centres.shape[1])).astype(np.int32)
                rows = pa.array(np.repeat(np.arange(len(at)), at.shape[1]))
                yield pa.record_batch([b.column(0).take(rows), pa.array(at.ravel()), b.column(1).take(rows)], ["qid", "list", "v"])

    q = questions.where(F.size(qvec) > 0).select(F.col(qid).alias("qid"), F.col(qvec).alias("v"))
    return q.mapInArrow(run, T.StructType([q.schema["qid"], T.StructField("list", T.IntegerType()), q.schema["v"]]))


def candidates(questions: DataFrame, index: VectorIndex, rerank: int, qid: str = "qid", qvec: str = "embedding",
               block: int = BLOCK) -> DataFrame:
    """(qid, item, approx): a question's ``rerank`` best by codes. A cell meets the
    codes of one shard with one block of the list's questions: a task holds the
    block's tables and streams the codes past them, so neither a hot list nor a
    list that very many questions probe comes into one task."""
    asks = probed(questions, index, qid, qvec)
    path = scratch_path(asks.sparkSession, "ivf-asks")
    asks.write.parquet(path)
    asks = asks.sparkSession.read.schema(asks.schema).parquet(path)
    per = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).join(index.lists, "list")
    item = index.codes.schema[index.item_id].dataType

    def empty(t):
        return F.lit(None).cast(t)

    q = asks.join(per, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("qid"), "blocks").cast("int").alias("block"), F.lit(False).alias("is_item"), "qid",
        empty(item).alias("item"), F.col("v").cast("array<double>").alias("v"), empty("binary").alias("code"))
    i = index.codes.join(per.select("list", "blocks"), "list").select(
        "list", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_item"),
        empty(asks.schema["qid"].dataType).alias("qid"), F.col(index.item_id).alias("item"),
        empty("array<double>").alias("v"), "code")
    cells = q.unionByName(i).repartition("list", "shard", "block").sortWithinPartitions("list", "shard", "block", "is_item")
    sent = asks.sparkSession.sparkContext.broadcast(index.partition)
    schema = T.StructType([asks.schema["qid"], T.StructField("item", item), T.StructField("approx", T.FloatType())])
    found = cells.mapInArrow(_scan(sent, rerank), schema)
    return R.top_k(found, rerank, ["qid"], [F.col("approx"), F.col("item")], "_r").drop("_r")


def _scan(sent, rerank: int):
    def values(col):
        return col.to_numpy(zero_copy_only=False)

    def runs(batches):
        for b in batches:
            if b.num_rows:
                key = np.stack([values(b.column(c)).astype(np.int64) for c in ("list", "shard", "block", "is_item")], 1)
                cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
                for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                    yield tuple(key[lo, :3]), bool(key[lo, 3]), b.slice(lo, hi - lo)

    def best_of(qids, table, rows):
        """Rows of a cell's questions: each one's best codes of a batch."""
        items = rows.column("item")
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(items), -1)
        d = np.zeros((len(table), len(items)), np.float32)
        for j in range(code.shape[1]):
            d += table[:, j, code[:, j]]
        keep = min(rerank, len(items))
        cols = np.argsort(d, axis=1, kind="stable")[:, :keep]
        return pa.record_batch([pa.array(np.repeat(np.arange(len(d)), keep)).cast(pa.int64()), items.take(pa.array(cols.ravel())),
                                pa.array(np.take_along_axis(d, cols, 1).ravel())], ["q", "item", "approx"]), qids

    def out(part):
        found, qids = part
        return pa.record_batch([qids.take(found.column("q")), found.column("item"), found.column("approx")],
                               ["qid", "item", "approx"])

    def run(batches):
        at, ids, vecs, table, qids = None, [], [], None, None
        for cell, is_item, rows in runs(batches):
            if cell != at:
                at, ids, vecs, table = cell, [], [], None
            if not is_item:
                ids.append(rows.column("qid"))
                vecs += rows.column("v").to_pylist()
            elif ids:
                if table is None:
                    table, qids = sent.value.tables(np.array(vecs, float), int(at[0])), pa.concat_arrays(ids)
                for lo in range(0, rows.num_rows, 4096):
                    yield out(best_of(qids, table, rows.slice(lo, 4096)))
    return run


def knn(questions: DataFrame, index: VectorIndex, k: int, *, rerank: int | None = None, qid: str = "qid",
        qvec: str = "embedding") -> DataFrame:
    """(qid, item, dist): the ``k`` nearest of each question, ties to the smaller id;
    exact where the index found no structure, else the best of ``rerank`` (16 k)
    candidates by exact distance."""
    if not index.structured:
        return R.knn(questions.where(F.size(qvec) > 0), index.vectors, k, qid=qid, qvec=qvec, item_id=index.item_id, ivec=index.vec)
    cand = candidates(questions, index, rerank or 16 * k, qid, qvec).withColumnRenamed("item", index.item_id)
    met = cand.join(index.vectors, index.item_id).join(
        questions.select(F.col(qid).alias("qid"), F.col(qvec).alias("_qvec")), "qid")
    scored = met.select(F.col("qid").alias(qid), index.item_id, _dist(F.col("_qvec"), F.col(index.vec)).alias("dist"))
    return R.top_k(scored, k, [qid], [F.col("dist"), F.col(index.item_id)], "_r").drop("_r")
