"""Sparse term vectors, written with the corpus, and their search.

A vector is two arrays: ``indices``, ascending, and ``weights``. A term's index is
32 bits of its MD5 modulo ``dims``; its weight is its count times
ln((n + 1) / (df + 1)), and the vector has length 1 (0 without a term that tells
chunks apart). A chunk of 1 KB takes some 150 numbers, whatever ``dims`` is.

``count_terms`` tokenises the texts once and stores (id, indices, tfs) beside the
other columns; frequencies and weights follow from these rows. Frequencies have at
most ``dims`` rows (2 MB at 2^18), which is what is broadcast, so a vector is made
within its row: nothing is shuffled. The distance of two vectors is sqrt(2 - 2 cos)
and needs the shared indices only: ``nearest`` sends blocks of questions and blocks of
items, cut to the indices that are asked, to the cells of a grid, each of which keeps
its k best; pairs of questions and items are never shuffled.

Null and empty texts have empty vectors, are written, and are nobody's neighbour.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.retrieve import term_tokens, top_k
from quarry.session import scratch_path

DIMS = 1 << 18
CELL_QUESTIONS = 512
ROWS = 1024  # items that a cell scores at once


def _lists(of_row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    ends = np.cumsum(np.bincount(of_row, minlength=n), dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def count_terms(chunks: DataFrame, text: str = "text", dims: int = DIMS) -> DataFrame:
    """The rows of ``chunks`` with (indices, tfs): index and count of each different
    index of a text; tokenised once and stored."""
    spark = chunks.sparkSession
    tokens = chunks.withColumn("_tokens", term_tokens(F.coalesce(F.col(text), F.lit(""))))

    def run(batches):
        for rows in batches:
            terms = rows.column(rows.schema.get_field_index("_tokens"))
            row, words = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False), terms.flatten().dictionary_encode()
            index = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in words.dictionary.to_pylist()], dtype=np.int64)
            key, tf = np.unique(row.astype(np.int64) * dims + index[words.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            of = key // dims
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], _lists(of, rows.num_rows, pa.array((key % dims).astype(np.int32))), _lists(of, rows.num_rows, pa.array(tf.astype(np.int32)))],
                [*rows.schema.names[:-1], "indices", "tfs"])
    schema = T.StructType([*chunks.schema.fields, T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    path = scratch_path(spark, "counted")
    tokens.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _counted(chunks: DataFrame, text: str, dims: int) -> DataFrame:
    return chunks if "tfs" in chunks.columns else count_terms(chunks, text, dims)


def fit_idf(chunks: DataFrame, text: str = "text", id_col: str = "chunk_id", dims: int = DIMS) -> DataFrame:
    """(i, idf) of every index in use, of texts or of rows of ``count_terms``; one row an index, ``dims`` at most."""
    counted = _counted(chunks.select(id_col, text) if "tfs" not in chunks.columns else chunks, text, dims)
    df = counted.select(F.explode("indices").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    return df.select("i", F.log(F.lit(counted.count() + 1.0) / (F.col("df") + 1)).alias("idf"))


def _one_row_an_id(rows: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Rows of one id are one text: their counts stand side by side."""
    repeated = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias("_id"))
    if repeated.isEmpty():
        return rows
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    merged = rows.join(repeated, same, "left_semi").groupBy(id_col).agg(F.collect_list(F.struct("indices", "tfs")).alias("c")).select(
        id_col, F.flatten("c.indices").alias("indices"), F.flatten("c.tfs").alias("tfs"))
    if cols:
        merged = rows.join(repeated, same, "left_semi").select(F.col(id_col).alias("_id"), *cols).join(merged, same).drop("_id")
    return rows.join(repeated, same, "left_anti").unionByName(merged.select(rows.columns))


def embed(chunks: DataFrame, idf: DataFrame, text: str = "text", id_col: str = "chunk_id", dims: int = DIMS,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, indices, weights), a row an id of ``chunks`` (texts, or rows of
    ``count_terms``); with ``keep``, a row per row, with these columns. Terms that
    ``idf`` does not know are left out."""
    counted = _counted(chunks, text, dims).select(id_col, *keep, "indices", "tfs")
    known = idf.toPandas()  # ``dims`` rows at most
    table = np.full(dims, np.nan)
    table[known["i"].to_numpy(dtype=np.int64)] = known["idf"].to_numpy(dtype=float)
    shared, n_kept = counted.sparkSession.sparkContext.broadcast(table), 1 + len(keep)

    def run(batches):
        for rows in batches:
            row, i = _flat(rows.column(n_kept))
            w = rows.column(n_kept + 1).flatten().to_numpy(zero_copy_only=False) * shared.value[i]
            found = ~np.isnan(w)
            row, i, w = row[found], i[found], w[found]
            if np.any((row[1:] == row[:-1]) & (i[1:] <= i[:-1])):
                order = np.lexsort((w, i, row))
                row, i, w = row[order], i[order], w[order]
            norm = np.sqrt(np.bincount(row, w * w, rows.num_rows))[row]
            w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
            yield pa.RecordBatch.from_arrays([*rows.columns[:n_kept], _lists(row, rows.num_rows, pa.array(i)), _lists(row, rows.num_rows, pa.array(w))],
                                             [*rows.schema.names[:n_kept], "indices", "weights"])
    fields = [counted.schema[c] for c in (id_col, *keep)]
    schema = T.StructType([*fields, T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return _one_row_an_id(counted, id_col, list(keep)).mapInArrow(run, schema)


def nearest(questions: DataFrame, vectors: DataFrame, k: int, *, qid: str = "qid", item_id: str = "chunk_id",
            shards: int | None = None) -> DataFrame:
    """(qid, item, dist, rank): the ``k`` nearest items that share a weighted term;
    distances are rounded to six places, ties go to the smaller id. ``shards``: blocks
    of items (default: the number of shuffle partitions)."""
    spark = vectors.sparkSession
    asked = questions.select(F.col(qid).alias("_q"), "indices", "weights").checkpoint()  # the questions' words
    table = np.zeros(DIMS, dtype=bool)
    used = asked.select(F.explode("indices").alias("i")).distinct().toPandas()["i"].to_numpy(dtype=np.int64)  # DIMS rows at most
    if len(used) and used.max() >= len(table):
        table = np.zeros(used.max() + 1, dtype=bool)
    table[used] = True
    shared = spark.sparkContext.broadcast(table)
    n_i = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_q = max(1, -(-asked.count() // CELL_QUESTIONS))
    q_type, i_type = asked.schema["_q"].dataType, vectors.schema[item_id].dataType
    i_schema = T.StructType([T.StructField("_i", i_type), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def cut(batches):
        for rows in batches:
            row, i = _flat(rows.column(1))
            w = rows.column(2).flatten().to_numpy(zero_copy_only=False)
            met = (w > 0) & (i < len(shared.value))
            met[met] = shared.value[i[met]]
            row, i, w = row[met], i[met], w[met]
            some, row = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some)), _lists(row, len(some), pa.array(i)), _lists(row, len(some), pa.array(w))],
                                             ["_i", "indices", "weights"])
    items = vectors.select(item_id, "indices", "weights").mapInArrow(cut, i_schema)

    def dealt(df, own, other, n_own, n_other, key, is_item):
        ids = [F.lit(None).cast(q_type).alias("_q"), F.col("_i")] if is_item else [F.col("_q"), F.lit(None).cast(i_type).alias("_i")]
        return df.select(F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own), F.lit(is_item).alias("_item"), *ids, "indices", "weights",
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
    grid = dealt(asked, "_qb", "_ib", n_q, n_i, "_q", False).unionByName(dealt(items, "_ib", "_qb", n_i, n_q, "_i", True))
    grid = grid.withColumn("_c", F.col("_qb") * n_i + F.col("_ib")).repartitionById(n_i * min(n_q, 16), F.col("_c"))
    grid = grid.sortWithinPartitions("_c", "_item", "_i").select("_c", "_item", "_q", "_i", "indices", "weights")
    out = T.StructType([T.StructField(qid, q_type), T.StructField(item_id, i_type), T.StructField("dist", T.DoubleType())])
    found = grid.mapInArrow(_cells(k, [qid, item_id, "dist"]), out)
    return top_k(found, k, [qid], [F.col("dist"), F.col(item_id)])


def _cells(k: int, names: list[str]):
    def run(batches):
        at = cell = None
        for rows in batches:
            c, kind = (rows.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, rows.num_rows]) if rows.num_rows else ():
                if c[lo] != at:
                    if cell:
                        yield from cell.finish(names)
                    at, cell = c[lo], _Cell(k)
                if not kind[lo]:
                    cell.asked.append(rows.slice(lo, hi - lo))
                elif cell.asked:
                    for a in range(lo, hi, ROWS):
                        cell.items(rows.slice(a, min(ROWS, hi - a)))
        if cell:
            yield from cell.finish(names)
    return run


class _Cell:
    """The ``k`` nearest items of each question of a block; items come in the order
    of their ids, so at equal distances the earlier one is the better."""

    def __init__(self, k: int):
        self.k, self.asked, self.matrix, self.best = k, [], None, None

    def items(self, rows):
        if self.matrix is None:
            q = pa.concat_arrays([r.column(2) for r in self.asked])
            row, i = _flat(pa.concat_arrays([r.column(4) for r in self.asked]))
            w = np.maximum(pa.concat_arrays([r.column(5) for r in self.asked]).flatten().to_numpy(zero_copy_only=False), 0.0)
            # rows of one question are one question
            code = q.dictionary_encode(null_encoding="encode")
            self.qids, row = code.dictionary, code.indices.to_numpy(zero_copy_only=False)[row]
            self.used, i = np.unique(i, return_inverse=True)
            self.matrix = np.zeros((len(self.used), len(self.qids)))
            np.add.at(self.matrix, (i, row), w)
        row, i = _flat(rows.column(4))
        w = rows.column(5).flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.used, i)
        met = at < len(self.used)
        met[met] = self.used[at[met]] == i[met]
        dense = np.zeros((rows.num_rows, len(self.used)))
        np.add.at(dense, (row[met], at[met]), w[met])
        cos = dense @ self.matrix
        dist = _places(np.sqrt(np.maximum(0.0, _places(2 - 2 * cos, 9))), 6)
        dist[cos <= 0] = np.inf
        if self.best is not None:  # only rows that are nearer than a question's k-th
            near = np.flatnonzero(np.any(dist < self.best[0][-1], axis=1))
        else:
            near = np.flatnonzero(np.any(dist < np.inf, axis=1))
        if not len(near):
            return
        ids = np.array(rows.column(3).take(pa.array(near)).to_pylist() + [None], dtype=object)[:-1]
        ids = np.broadcast_to(ids[:, None], (len(near), len(self.qids)))
        dist = dist[near]
        if self.best is not None:
            dist, ids = np.concatenate([self.best[0], dist]), np.concatenate([self.best[1], ids])
        order = np.argsort(dist, axis=0, kind="stable")[:self.k]
        dist, ids = np.take_along_axis(dist, order, axis=0), np.take_along_axis(ids, order, axis=0)
        if len(dist) < self.k:
            more = self.k - len(dist), dist.shape[1]
            dist, ids = np.concatenate([dist, np.full(more, np.inf)]), np.concatenate([ids, np.full(more, None)])
        self.best, self.type = (dist, ids), rows.column(3).type

    def finish(self, names):
        if self.best is not None:
            at, q = np.nonzero(self.best[0] < np.inf)
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(q)), pa.array(self.best[1][at, q].tolist(), self.type), pa.array(self.best[0][at, q])], names)


def _places(a: np.ndarray, n: int) -> np.ndarray:
    return np.floor(a * 10.0 ** n + 0.5) / 10.0 ** n


def write_vectors(vectors: DataFrame, path: str, by: str = "session_id", item_id: str = "chunk_id") -> None:
    """The corpus rows with their vectors (``embed`` with ``keep``), a folder a session, so that a session is
    read alone with its vectors."""
    vectors.where(F.col(item_id).isNotNull()).write.partitionBy(by).parquet(path)
