"""Batch retrieval: N questions against M chunks in one job.

* ``bm25`` - lexical scoring as an equi-join on terms (J9).
* ``knn`` - exact nearest neighbours: blocks of questions meet blocks of items
  in the cells of a grid; a task scores a cell with numpy and keeps a partial
  top-k, then one shuffle by question finishes the top-k (J3/T1). No pair
  table is ever materialised and no vector passes through the driver.
* ``mmr`` - greedy diversity re-rank per question over a bounded pool (T2).
* ``coverage`` - nearest chunks of every source missing from a result (W1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import exprs as X


# ---------------------------------------------------------------------------
# Lexical scoring (BM25)
# ---------------------------------------------------------------------------

# An ending is taken off a word if four characters or more are left.
STEM_RE = r"^(.{4,}?)(?:ings|ing|edly|ed|ies|es|ly|s|e)$"


def term_tokens(col, stem: bool = False):
    t = X.tokens(col)
    if stem:
        t = F.transform(t, lambda w: F.regexp_replace(w, STEM_RE, "$1"))
    return t


def term_index(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """Inverted index rows ``(chunk_id, term, tf, dl)``. Built once per corpus
    and stored bucketed by term in production; here built on the fly."""
    toks = chunks.select("chunk_id", term_tokens(F.col("text"), stem).alias("toks"))
    return (toks.select("chunk_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
            .groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))


def corpus_stats(chunks: DataFrame, stem: bool = False) -> tuple[int, float]:
    """(N, avgdl): two scalars, the only values that reach the driver."""
    # Stemming keeps the token count, so one regex count serves both forms.
    r = chunks.select(F.regexp_count(F.lower("text"), F.lit(X.TOKEN_RE)).alias("dl")) \
              .agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return int(r["n"]), float(r["avgdl"] or 0.0)


def _kept(max_df_ratio: float | None, n: int):
    return F.lit(True) if max_df_ratio is None else F.col("df") <= F.lit(max_df_ratio * n)


def bm25(questions: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75,
         max_df_ratio: float | None = None, stem: bool = False, text_col: str = "question") -> DataFrame:
    """All (qid, chunk_id, score) with score > 0.

    ``score = sum over distinct query terms t present in the chunk of
    ln(1 + (N - df + .5)/(df + .5)) * tf (k1+1) / (tf + k1 (1 - b + b dl/avgdl))``
    rounded to 6 places. Every term counts, common ones too, unless the caller
    sets ``max_df_ratio``; AQE splits the join partitions that hot terms fill.

    Plan: query terms are distinct per question; the chunk token stream is
    semi-joined to the query vocabulary *before* the (chunk, term) aggregation,
    so only terms that some question uses are ever shuffled."""
    n, avgdl = corpus_stats(chunks, stem)
    qt = questions.select("qid", F.explode(F.array_distinct(term_tokens(F.col(text_col), stem)))
                          .alias("term"))
    vocab = qt.select("term").distinct()
    toks = chunks.select("chunk_id", term_tokens(F.col("text"), stem).alias("toks"))
    occ = (toks.select("chunk_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
           .join(vocab, "term", "left_semi"))
    tf = occ.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    # The (always true) predicate keeps both aggregate columns alive, so this
    # branch has the same plan as ``tf`` and Spark reuses its shuffle instead
    # of tokenising the corpus a second time.
    dfs = (tf.where((F.col("tf") > 0) & (F.col("dl") >= 0)).groupBy("term")
           .agg(F.count(F.lit(1)).alias("df"))
           .where(_kept(max_df_ratio, n)))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm)
    weighted = tf.join(dfs, "term").select("chunk_id", "term", part.alias("w"))
    return (qt.join(weighted, "term").groupBy("qid", "chunk_id")
            .agg(F.round(F.sum("w"), 6).alias("score")))


def bm25_in_scope(questions: DataFrame, chunks: DataFrame, scope: str = "session_id", k1: float = 1.2, b: float = 0.75,
                  stem: bool = False, text_col: str = "question", k: int | None = None, group: str | None = None) -> DataFrame:
    """(qid, scope, chunk_id[, group], score): ``bm25`` within each scope, whose
    chunks alone make up N, avgdl and the document frequencies. The scope is a part
    of every key, so a session costs what its own chunks cost; its statistics are
    an aggregate that stays in Spark. ``k`` and ``group`` as in ``bm25_indexed``."""
    qt = questions.select("qid", scope, F.explode(F.array_distinct(term_tokens(F.col(text_col), stem))).alias("term"))
    rows, forward = _stored_forward(chunks, stem, group, [scope, "chunk_id"])
    stats = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    dfs = (forward.select(scope, F.explode("terms").alias("term")).join(qt.select(scope, "term").distinct(), [scope, "term"], "left_semi")
           .groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df")).join(stats, scope))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = qt.join(dfs, [scope, "term"]).select("qid", scope, "term", idf.alias("idf"), "avgdl")
    return _in_cells(asked, forward, k1, b, k, group, scope, n=rows.count())


class TermIndex:
    """A stored index by chunk: ``forward (chunk_id, dl, terms, tfs[, groups])``,
    document frequencies ``(term, df)`` and the corpus scalars. Built once at
    ingest (``build_term_index``), so answering a batch of questions never
    re-tokenises the corpus."""

    def __init__(self, forward: DataFrame, dfs: DataFrame, n: int, avgdl: float, stem: bool):
        self.forward, self.dfs, self.n, self.avgdl, self.stem = forward, dfs, n, avgdl, stem


def _forward(chunks: DataFrame, stem: bool, keys: list[str]) -> DataFrame:
    """(keys, dl, terms, tfs): every chunk's counted terms, made within the row."""
    from quarry.operators.postings import counted_terms
    toks = chunks.select(*keys, F.col("text").isNotNull().alias("_t"), term_tokens(F.col("text"), stem).alias("toks"))
    rows = toks.select(*keys, F.when(F.col("_t"), F.size("toks").cast("long")).alias("dl"), counted_terms(F.col("toks")).alias("c"))
    return rows.select(*keys, "dl", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs"))


def _one_chunk_an_id(forward: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one id are one chunk: its counts are added up, a term's length is
    the greatest of its rows. The terms of such a chunk may lie in several rows,
    one a length; each names all of the chunk's groups."""
    repeated = forward.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in keys])
    if repeated.isEmpty():
        return forward
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    old = forward.join(repeated, same, "left_semi")
    terms = old.select(*keys, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy(*keys, F.col("e.terms").alias("term")).agg(
        F.sum("e.tfs").cast("int").alias("tf"), F.max("dl").alias("dl"))
    merged = terms.groupBy(*keys, "dl").agg(F.collect_list(F.struct("term", "tf")).alias("c")).select(
        *keys, "dl", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs"))
    if "groups" in forward.columns:
        of = old.select(*[F.col(c).alias(f"_{c}") for c in keys], F.explode("groups").alias("g")).groupBy(*[f"_{c}" for c in keys]).agg(
            F.collect_set("g").alias("groups"))
        merged = merged.join(of, same).select(*keys, "dl", "terms", "tfs", "groups")
    return forward.join(repeated, same, "left_anti").select(*merged.columns).unionByName(merged)


def _stored_forward(chunks: DataFrame, stem: bool, group: str | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The forward rows as written (a row a chunk row), and a chunk an id."""
    spark = chunks.sparkSession
    from quarry.session import scratch_path
    path = scratch_path(spark, "terms")
    rows = _forward(chunks, stem, [*keys, group] if group else keys)
    if group:
        rows = rows.withColumn("groups", F.array(F.struct(F.col(group).alias("g")))).drop(group)
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    return rows, _one_chunk_an_id(rows, keys)


def build_term_index(chunks: DataFrame, stem: bool = False, group: str | None = None) -> TermIndex:
    """Index of ``chunks(chunk_id, text[, group])``, written below the shared
    checkpoint folder; ``group`` is a column to take the best chunks by."""
    rows, forward = _stored_forward(chunks, stem, group, ["chunk_id"])
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    # chunks of a term: rows of an id that is there twice hold different terms
    dfs = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return TermIndex(forward, dfs, int(size["n"]), float(size["avgdl"] or 0.0), stem)


def _asked(questions: DataFrame, index: TermIndex, max_df_ratio: float | None, text_col: str) -> DataFrame:
    """(qid, term, idf, avgdl) of the questions' terms that the index has."""
    qt = questions.select("qid", F.explode(F.array_distinct(term_tokens(F.col(text_col), index.stem))).alias("term"))
    dfs = (index.dfs.join(qt.select("term").distinct(), "term", "left_semi")
           .where(_kept(max_df_ratio, index.n)))
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return qt.join(dfs, "term").select("qid", "term", idf.alias("idf"), F.lit(index.avgdl or 1.0).alias("avgdl"))


def bm25_indexed(questions: DataFrame, index: TermIndex, k1: float = 1.2, b: float = 0.75,
                 max_df_ratio: float | None = None, text_col: str = "question", k: int | None = None,
                 group: str | None = None) -> DataFrame:
    """BM25 (same contract as ``bm25``) over a stored ``TermIndex``, chunk by
    chunk (``_in_cells``). With ``k`` only rows that can be among the k best of a
    question (ties by chunk id) come out, or among the k best of a question and
    one of the index's groups, in a column named ``group``."""
    return _in_cells(_asked(questions, index, max_df_ratio, text_col), index.forward, k1, b, k, group, n=index.n)


def bm25_pairs(questions: DataFrame, index: TermIndex, pairs: DataFrame, k1: float = 1.2, b: float = 0.75,
               text_col: str = "question") -> DataFrame:
    """Scores of given (qid, chunk_id) pairs; pairs that share no term are not in it."""
    rows = pairs.select("qid", "chunk_id").join(index.forward, "chunk_id").select(
        "qid", "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("qid", "chunk_id", "dl", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("dl") / F.col("avgdl")))
    return rows.join(_asked(questions, index, None, text_col), ["qid", "term"]).groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


CELL_QUESTIONS, CELL_CHUNKS = 512, 1 << 15


def _in_cells(asked: DataFrame, forward: DataFrame, k1: float, b: float, k: int | None, group: str | None, scope: str | None = None,
              n: int | None = None, item_id: str = "chunk_id") -> DataFrame:
    """(qid[, scope], chunk_id[, group], score) of ``asked(qid, term, idf, avgdl[,
    scope])`` over forward rows.

    As in ``knn``, blocks of questions meet blocks of chunks in the cells of a
    grid. A chunk moves whole, once for every ``CELL_QUESTIONS`` questions; a
    cell adds up its scores and keeps the k best, so the pairs of questions and
    chunks, most of which share some common word, are never shuffled."""
    asked = asked.checkpoint()  # bounded by the questions' words
    n_i = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // CELL_CHUNKS))
    n_q = max(1, -(-asked.select("qid").distinct().count() // CELL_QUESTIONS))
    g_type = forward.schema["groups"].dataType.elementType["g"].dataType if group else T.IntegerType()
    s_type = forward.schema[scope].dataType if scope else T.IntegerType()
    q_type, i_type = asked.schema["qid"].dataType, forward.schema[item_id].dataType
    null = F.lit(None)

    def dealt(df, own, other, n_own, n_other, key, is_item, cols):
        s = F.col(scope) if scope else F.lit(0)
        return df.select(F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own), s.alias("_s"), F.lit(is_item).alias("_item"),
                         *cols, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
    q = dealt(asked, "_qb", "_ib", n_q, n_i, "qid", False, [
        F.col("qid").alias("_q"), null.cast(i_type).alias("_i"), null.cast(g_type).alias("_g"), F.col("avgdl").alias("_l"),
        F.array("term").alias("_t"), null.cast("array<int>").alias("_n"), F.col("idf").alias("_w")])
    items = forward.select("*", F.explode("groups").alias("_of")) if group else forward
    i = dealt(items.where(F.size("terms") > 0), "_ib", "_qb", n_i, n_q, item_id, True, [
        null.cast(q_type).alias("_q"), F.col(item_id).alias("_i"), (F.col("_of.g") if group else null.cast(g_type)).alias("_g"),
        F.col("dl").cast("double").alias("_l"), F.col("terms").alias("_t"), F.col("tfs").alias("_n"), null.cast("double").alias("_w")])
    if scope:  # a null scope meets none, as in a join
        q, i = q.where(F.col("_s").isNotNull()), i.where(F.col("_s").isNotNull())
    grid = q.unionByName(i).withColumn("_c", F.col("_qb") * n_i + F.col("_ib")).repartitionById(n_i * min(n_q, 16), F.col("_c"))
    grid = grid.sortWithinPartitions("_c", "_s", "_item", "_i", "_g").select("_c", "_s", "_item", "_q", "_i", "_g", "_l", "_t", "_n", "_w")
    fields = [("qid", q_type), ("_s", s_type), (item_id, i_type), ("_g", g_type), ("score", T.DoubleType())]
    res = grid.mapInArrow(_bm25_cells(k1, b, k, [name for name, _ in fields]), T.StructType([T.StructField(*f) for f in fields]))
    return res.select("qid", *([F.col("_s").alias(scope)] if scope else []), item_id, *([F.col("_g").alias(group)] if group else []), "score")


def _bm25_cells(k1, b, k, names):
    slice_rows = 64

    def codes(col):
        return col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def runs(batches):
        """(cell and scope, questions or chunks, rows): neighbours of one kind, in order."""
        for rows in batches:
            if not rows.num_rows:
                continue
            key = [codes(rows.column(c)) for c in range(3)]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, rows.num_rows]):
                for at in range(lo, hi, slice_rows):
                    part = rows.slice(at, min(slice_rows, hi - at))
                    yield (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part.column(2)[0].as_py(), part

    def run(batches):
        at, cell = None, None
        for key, is_item, rows in runs(batches):
            if key != at:
                if cell:
                    yield from cell.finish()
                at, cell = key, _Bm25Cell(k1, b, k, names, rows)
            if is_item:
                yield from cell.chunks(rows)
            else:
                cell.ask(rows)
        if cell:
            yield from cell.finish()
    return run


class _Bm25Cell:
    """The scores of a block of questions over chunks that come in the order of
    their ids; at equal scores the earlier one is the better."""

    LIMIT = 1 << 19  # scores held before they are reduced

    def __init__(self, k1, b, k, names, rows):
        self.k1, self.b, self.k, self.names = k1, b, k, names
        self.scope, self.kinds = rows.column(1).slice(0, 1), [rows.column(c).type for c in (3, 4, 5)]
        self.terms, self.qids, self.asked, self.idf, self.avgdl = {}, {}, [], [], 1.0
        self.matrix = self.open = None
        self.groups, self.least = {}, None
        self.kept, self.size, self.limit, self.seen = [], 0, self.LIMIT, 0

    def ask(self, rows):
        for qid, term, idf in zip(rows.column(3).to_pylist(), rows.column(7).flatten().to_pylist(), rows.column(9).to_pylist()):
            at = self.terms.setdefault(term, len(self.terms))
            if at == len(self.idf):
                self.idf.append(idf)
            self.asked.append((at, self.qids.setdefault(qid, len(self.qids))))
        self.avgdl = rows.column(6)[0].as_py()

    def chunks(self, rows):
        if not self.qids:
            return
        if self.matrix is None:
            self.matrix = np.zeros((len(self.terms), len(self.qids)))
            np.add.at(self.matrix, tuple(np.array(self.asked).T), 1.0)
            self.words, self.idf = pa.array(list(self.terms), pa.string()), np.array(self.idf)
        ids, groups, dl = rows.column(4), rows.column(5), rows.column(6).to_numpy(zero_copy_only=False)
        of_row = pc.list_parent_indices(rows.column(7)).to_numpy()
        term = pc.fill_null(pc.index_in(rows.column(7).flatten(), self.words), -1).to_numpy(zero_copy_only=False)
        tf = rows.column(8).flatten().to_numpy(zero_copy_only=False)[term >= 0].astype(float)
        of_row, term = of_row[term >= 0], term[term >= 0]
        weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[of_row] / self.avgdl))
        by_row = np.zeros((rows.num_rows, len(self.qids)))
        if len(term):
            first = np.flatnonzero(np.r_[True, of_row[1:] != of_row[:-1]])
            for lo in range(0, len(first), 8):
                z = first[lo + 8] if lo + 8 < len(first) else len(term)
                a = first[lo]
                by_row[of_row[first[lo:lo + 8]]] = np.add.reduceat(self.matrix[term[a:z]] * weight[a:z, None], first[lo:lo + 8] - a, axis=0)
        code = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in (ids, groups)]
        start = np.flatnonzero(np.r_[True, (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1])])
        sums = np.add.reduceat(by_row, start, axis=0)
        ids, groups = ids.take(pa.array(start)), groups.take(pa.array(start))
        if self.open:
            if all(a[0].as_py() == b[0].as_py() for a, b in zip(self.open, (ids, groups))):
                sums[0] += self.open[2][0]
            else:
                ids, groups = pa.concat_arrays([self.open[0], ids]), pa.concat_arrays([self.open[1], groups])
                sums = np.concatenate([self.open[2], sums])
        self.open = ids.slice(len(ids) - 1), groups.slice(len(ids) - 1), sums[-1:]
        yield from self.add(ids.slice(0, len(ids) - 1), groups.slice(0, len(ids) - 1), sums[:-1])

    def add(self, ids, groups, sums):
        """Scores of whole chunks."""
        g = np.array([self.groups.setdefault(v, len(self.groups)) for v in groups.to_pylist()], dtype=np.int64)
        chunk, q = np.nonzero(sums > 0)
        score = _round6(sums[chunk, q])
        if self.least is not None and len(g) and g.max() < self.least.shape[1]:
            good = score > self.least[q, g[chunk]]
            chunk, q, score = chunk[good], q[good], score[good]
        used, chunk = np.unique(chunk, return_inverse=True)
        self.kept.append((q, g[used][chunk], score, self.seen + used[chunk], ids.take(pa.array(used)).take(pa.array(chunk))))
        self.seen += len(ids)
        self.size += len(q)
        if self.size > self.limit:
            if self.k is None:
                yield self.batch()
            else:
                self.reduce()
                self.limit = max(self.LIMIT, 2 * self.size)

    def merged(self):
        q, g, score, seen = (np.concatenate([part[c] for part in self.kept]) for c in range(4))
        return q, g, score, seen, pa.concat_arrays([part[4] for part in self.kept])

    def reduce(self):
        q, g, score, seen, ids = self.merged()
        order = np.lexsort((seen, -score, g, q))
        q, g, score, seen = q[order], g[order], score[order], seen[order]
        first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        best = rank < self.k
        if len(self.qids) * len(self.groups) <= 1 << 20:
            self.least = np.full((len(self.qids), len(self.groups)), -1.0)
            last = rank == self.k - 1
            self.least[q[last], g[last]] = score[last]
        self.kept = [(q[best], g[best], score[best], seen[best], ids.take(pa.array(order[best])))]
        self.size = int(best.sum())

    def batch(self):
        q, g, score, _, ids = self.merged()
        self.kept, self.size = [], 0
        qids, groups = pa.array(list(self.qids), self.kinds[0]), pa.array(list(self.groups), self.kinds[2])
        scope = self.scope.take(pa.array(np.zeros(len(q), dtype=np.int64)))
        return pa.record_batch([qids.take(pa.array(q)), scope, ids, groups.take(pa.array(g)), pa.array(score)], self.names)

    def finish(self):
        if self.open:
            yield from self.add(*self.open)
        if self.kept:
            if self.k is not None:
                self.reduce()
            yield self.batch()


def top_k(df: DataFrame, k: int, part: list[str], order: list, rank_col: str = "rank") -> DataFrame:
    """Rank filter; Catalyst plans a partial WindowGroupLimit before the
    shuffle so at most k rows per key and input partition move."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def bm25_top(questions: DataFrame, chunks, k: int, **kw) -> DataFrame:
    """Top-k BM25 per question over chunks (indexed first) or a stored ``TermIndex``."""
    index = chunks if isinstance(chunks, TermIndex) else build_term_index(chunks, kw.pop("stem", False))
    return top_k(bm25_indexed(questions, index, k=k, **kw), k, ["qid"], [F.col("score").desc(), F.col("chunk_id")])


# ---------------------------------------------------------------------------
# Exact vector search
# ---------------------------------------------------------------------------

def _round6(a):
    return np.sign(a) * np.floor(np.abs(a) * 1e6 + 0.5) / 1e6


def knn(queries: DataFrame, items: DataFrame, k: int, *, qid: str = "qid", qvec: str = "embedding",
        item_id: str = "chunk_id", ivec: str = "embedding", group: str | None = None, scope: str | None = None,
        block: int = 8192, item_blocks: int | None = None, sub_batch: int = 2048) -> DataFrame:
    """Exact k nearest items (L2) per question, or per (question, group).

    Output ``(qid, item_id[, group], dist)``, dist rounded to 6 places, ties by
    item id; rows without a vector take no part. With ``scope`` (a column of
    both sides, say ``session_id``) a question sees the items of its own scope
    only; a null scope is one of its own.

    Questions and items are dealt to a grid of cells by hash: a cell meets one
    block of about ``block`` questions with one of ``item_blocks`` blocks of
    items (default: as many as it takes for a cell a shuffle partition). A task
    holds a cell's questions, streams its items past them and emits at most k
    rows per (question, group); one shuffle by question finishes the top-k.
    Where a table is searched in itself the comparisons grow with its square,
    and so do the copies of items that move, one for every ``block`` questions;
    a task's memory does not. No vector passes through the driver, which only
    counts the questions."""
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q = max(1, -(-queries.count() // block))
    n_i = item_blocks or -(-partitions // n_q)
    fields = [T.StructField("qid", queries.schema[qid].dataType), T.StructField(item_id, items.schema[item_id].dataType)]
    if group:
        fields.append(T.StructField(group, items.schema[group].dataType))
    fields.append(T.StructField("dist", T.DoubleType()))

    def dealt(df, own, other, n_own, n_other, key, vec, is_item, cols):
        s = F.coalesce(F.concat(F.lit(":"), F.col(scope).cast("string")), F.lit("")) if scope else F.lit("")
        return df.where(F.col(vec).isNotNull()).select(
            F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own), s.alias("_s"), F.lit(is_item).alias("_item"),
            *cols, F.col(vec).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def empty(df, c):
        return F.lit(None).cast(df.schema[c].dataType)

    q = dealt(queries, "_qb", "_ib", n_q, n_i, qid, qvec, False,
              [F.col(qid).alias("_q"), empty(items, item_id).alias("_i"),
               (empty(items, group) if group else F.lit(None).cast("int")).alias("_g")])
    i = dealt(items, "_ib", "_qb", n_i, n_q, item_id, ivec, True,
              [empty(queries, qid).alias("_q"), F.col(item_id).alias("_i"),
               (F.col(group) if group else F.lit(None).cast("int")).alias("_g")])
    grid = (q.unionByName(i).withColumn("_c", F.col("_qb") * n_i + F.col("_ib"))
            .repartitionById(min(n_i * n_q, 16 * max(n_i, partitions)), F.col("_c")).sortWithinPartitions("_c", "_s", "_item")
            .select(F.concat(F.col("_c").cast("string"), "_s").alias("_c"), "_item", "_q", "_i", "_g", "_v"))
    res = grid.mapInArrow(_knn_cells(k, item_id, group, sub_batch), T.StructType(fields))
    part = ["qid"] + ([group] if group else [])
    res = top_k(res, k, part, [F.col("dist"), F.col(item_id)], "_r").drop("_r")
    return res.withColumnRenamed("qid", qid) if qid != "qid" else res


def _knn_cells(k, item_id, group, sub_batch):
    def values(col):
        return col.to_numpy(zero_copy_only=False)

    def matrix(col):
        if pc.count_distinct(pc.list_value_length(col)).as_py() > 1:
            raise ValueError("vectors of one search have one length")
        return values(col.flatten()).astype(np.float64).reshape(len(col), -1)

    def runs(batches):
        """(cell, questions or items, rows): neighbours of one kind, in order."""
        for b in batches:
            if b.num_rows:
                cell, item = values(b.column(0)), values(b.column(1))
                cut = np.flatnonzero((cell[1:] != cell[:-1]) | (item[1:] != item[:-1])) + 1
                for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
                    for at in range(lo, hi, sub_batch):
                        yield cell[lo], item[lo], b.slice(at, min(sub_batch, hi - at))

    def out(best):
        d = _reduce(pd.concat(best), k, item_id, group)
        return pa.RecordBatch.from_pandas(d, preserve_index=False)

    def run(batches):
        at, asked, q, best = None, [], None, []
        for cell, is_item, rows in runs(batches):
            if cell != at:
                if best:
                    yield out(best)
                at, asked, q, best = cell, [], None, []
            if not is_item:
                asked.append((values(rows.column(2)), matrix(rows.column(5))))
            elif asked:
                if q is None:
                    qids, q = np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked])
                    qn, bounds = (q * q).sum(1), {}
                step = max(32, (1 << 22) // len(q))  # items whose distances are held at once
                for lo in range(0, rows.num_rows, step):
                    part = rows.slice(lo, step)
                    x = matrix(part.column(5))
                    d2 = qn[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
                    best.append(_select(qids, q, x, np.maximum(d2, 0.0), values(part.column(3)),
                                        values(part.column(4)) if group else None, k, item_id, group, bounds))
                if len(best) > 8:
                    best = [_reduce(pd.concat(best), k, item_id, group)]
        if best:
            yield out(best)
    return run


def _select(qids, q, x, d2, ids, groups, k, item_id, group, bounds):
    """Candidates of the k nearest among these items; ``bounds`` holds, by group,
    the squared distance that k items seen so far are within."""
    rows = []
    keys = [None] if group is None else pd.unique(groups)
    for g in keys:
        cols = np.arange(len(ids)) if g is None else np.nonzero(groups == g)[0]
        sub = d2 if g is None else d2[:, cols]
        bound = bounds.setdefault(g, np.full(len(q), np.inf))
        near = sub <= bound[:, None]
        many = np.flatnonzero(near.sum(1) > k)
        if len(many):
            # the k-th smallest, with all that rounds to the same distance
            cut = np.partition(sub[many], k - 1, axis=1)[:, k - 1]
            bound[many] = np.minimum(bound[many], (np.sqrt(cut) + 1e-6) ** 2 + 1e-9)
            near[many] &= sub[many] <= bound[many, None]
        qi, ci = np.nonzero(near)
        cj = cols[ci]
        exact = np.sqrt(((q[qi] - x[cj]) ** 2).sum(1))
        df = pd.DataFrame({"qid": qids[qi], item_id: ids[cj], "dist": _round6(exact)})
        if group:
            df[group] = g
        rows.append(df)
    return _reduce(pd.concat(rows), k, item_id, group)


def _reduce(df, k, item_id, group):
    keys = ["qid"] + ([group] if group else [])
    df = df.sort_values(keys + ["dist", item_id])
    out = df.groupby(keys, sort=False).head(k)
    cols = ["qid", item_id] + ([group] if group else []) + ["dist"]
    return out[cols]


# ---------------------------------------------------------------------------
# MMR
# ---------------------------------------------------------------------------

def mmr(pool: DataFrame, queries: DataFrame, items: DataFrame, k: int, *, lambda_mult: float = 0.5,
        qid: str = "qid", qvec: str = "embedding", item_id: str = "chunk_id",
        ivec: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """From each question's pool pick ``k`` greedily: first the nearest,
    then argmax ``round(l*sim(q,d) - (1-l)*max sim(d, chosen), 6)``, ties by id.

    The pool is bounded (fetch_k rows per question); vectors are joined back
    only for pool rows, so embeddings never ride the top-k shuffle."""
    keep = keep or []
    df = (pool.select(qid, item_id, "dist", *keep)
          .join(items.select(item_id, F.col(ivec).alias("_iv")), item_id)
          .join(queries.select(qid, F.col(qvec).alias("_qv")), qid))
    id_type = items.schema[item_id].dataType
    fields = [T.StructField(qid, queries.schema[qid].dataType), T.StructField("rank", T.IntegerType()),
              T.StructField(item_id, id_type), T.StructField("dist", T.DoubleType())]
    fields += [pool.schema[c] for c in keep]
    schema = T.StructType(fields)

    out_cols = [f.name for f in fields]

    def pick_one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[item_id].to_numpy()
        order = np.lexsort((ids, pdf["dist"].to_numpy()))
        v = np.vstack(pdf["_iv"].to_numpy()).astype(np.float64)[order]
        qv = np.asarray(pdf["_qv"].iloc[0], dtype=np.float64)
        ids = ids[order]
        vn = np.sqrt((v * v).sum(1))
        sim_q = _round6(v @ qv / (vn * np.sqrt(qv @ qv)))
        sim_dd = _round6((v @ v.T) / np.outer(vn, vn))
        n = len(ids)
        kk = min(k, n)
        chosen = [0]
        free = np.ones(n, dtype=bool)
        free[0] = False
        red = sim_dd[:, 0].copy()  # max similarity to the chosen set so far
        while len(chosen) < kk:
            score = _round6(lambda_mult * sim_q - (1 - lambda_mult) * red)
            cand = np.nonzero(free)[0]
            best = cand[np.lexsort((ids[cand], -score[cand]))[0]]
            chosen.append(int(best))
            free[best] = False
            red = np.maximum(red, sim_dd[:, best])
        sel = order[np.asarray(chosen)]
        out = pdf.iloc[sel][[qid, item_id, "dist", *keep]].reset_index(drop=True)
        out["rank"] = np.arange(1, kk + 1, dtype=np.int32)
        return out[out_cols]

    def pick(batches):
        """Pools lie next to each other; the last of a batch may go on in the next one."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[qid] == pdf[qid].iloc[-1]
            done, rest = pdf[~last], pdf[last]
            if len(done):
                yield pd.concat([pick_one(g) for _q, g in done.groupby(qid, sort=False)], ignore_index=True)
        if rest is not None and len(rest):
            yield pick_one(rest)

    return df.repartition(qid).sortWithinPartitions(qid).mapInPandas(pick, schema)


# ---------------------------------------------------------------------------
# Coverage, routing, packing
# ---------------------------------------------------------------------------

def missing_sources(hits: DataFrame, per_source_best: DataFrame, source: str = "source") -> DataFrame:
    """(qid, source) pairs where the source has no chunk among the hits.

    ``per_source_best`` holds each question's best chunks per source (from
    ``knn(..., group=source)`` or a per-source BM25 top-k), so every
    (question, source) pair that could be topped up is already there: the
    anti-join needs no question x source product."""
    pairs = per_source_best.select("qid", source).distinct()
    return pairs.join(hits.select("qid", source).distinct(), ["qid", source], "left_anti")


def coverage(hits: DataFrame, per_source_best: DataFrame, per_source: int = 2,
             source: str = "source", item_id: str = "chunk_id", order: list | None = None) -> DataFrame:
    """For each source absent from ``hits`` its ``per_source`` best
    chunks (from ``per_source_best``, already top-k per (qid, source)).
    A single-source index gets no top-up: its source is among the hits.
    Ranked by (source, order...)."""
    order = order or [F.col("dist"), F.col(item_id)]
    present = hits.select("qid", source).distinct()
    extra = per_source_best.join(present, ["qid", source], "left_anti")
    extra = top_k(extra, per_source, ["qid", source], order, "_r").drop("_r")
    w = Window.partitionBy("qid").orderBy(F.col(source), *order)
    return extra.withColumn("rank", F.row_number().over(w))


# Intent patterns of the reference, flattened to one line
# (verbose-mode whitespace removed); case-insensitive.
FILE_LIST_RE = (r"(?i)\blist\s+(?:all\s+|the\s+)*(?:files?|docs?|documents?)"
                r"|\bnames?\s+(?:of\s+)?(?:all\s+|the\s+|uploaded\s+|indexed\s+)*(?:files?|docs?|documents?)"
                r"|\bhow\s+many\s+(?:files?|docs?|documents?)"
                r"|\b(?:which|what)\s+(?:files?|docs?|documents?)\s+"
                r"(?:do\s+you\s+have|have\s+you|are\s+(?:there|indexed|uploaded|available|loaded)|exist)"
                r"|\b(?:files?|documents?)\s+(?:are\s+)?indexed\b")
COMPUTE_RE = (r"(?i)\b(total|totals|subtotal|grand\s+total|sum|sums|count|counts|how\s+many|"
              r"number\s+of|average|avg|mean|median|max(?:imum)?|min(?:imum)?|"
              r"highest|lowest|largest|smallest|most|least|"
              r"opening\s+balance|closing\s+balance|balance|net\s+amount|aggregate)\b")
BROAD_RE = (r"(?i)\b(summar(?:y|ies|ize|ise|ising|izing)|overview|recap|tl;?dr|"
            r"all\s+the|all\s+of|each\b|every\b|list\s+all|"
            r"what\s+are\s+all|across\s+all|whole\s+(?:document|doc|file|report))\b")


def route(questions: DataFrame, has_files: str | None = None, has_tables: str | None = None,
          text: str = "question") -> DataFrame:
    """P10: route = file_list > table_compute (only when tables exist) >
    broad > specific. A file_list question with no files falls through."""
    q = F.col(text)
    files_ok = F.col(has_files) if has_files else F.lit(True)
    tables_ok = F.col(has_tables) if has_tables else F.lit(True)
    return questions.withColumn("route", F.when(q.rlike(FILE_LIST_RE) & files_ok, "file_list")
                                .when(q.rlike(COMPUTE_RE) & tables_ok, "table_compute")
                                .when(q.rlike(BROAD_RE), "broad").otherwise("specific"))


def adaptive_k(questions: DataFrame, totals: DataFrame, base_k: int = 5, broad_cap: int = 60,
               specific_floor: int = 16, by: str = "session_id", text: str = "question") -> DataFrame:
    """K and fetch_k per question from its session's chunk count.
    ``totals`` has one row per session (bounded by the session count)."""
    t = F.col("n_chunks")
    broad = F.col(text).rlike(BROAD_RE)
    k = F.greatest(F.lit(1), F.when(broad, F.least(t, F.lit(broad_cap)))
                   .otherwise(F.least(t, F.greatest(F.lit(base_k), F.lit(specific_floor)))))
    return (questions.join(totals.select(by, "n_chunks"), by, "left")
            .withColumn("n_chunks", F.coalesce(t, F.lit(base_k)))
            .withColumn("k", k.cast("int"))
            .withColumn("fetch_k", F.greatest(F.lit(20), F.col("k") * 4).cast("int")))


def pack_context(hits: DataFrame, chunks: DataFrame, manifest: DataFrame, by: str) -> DataFrame:
    """Manifest line, blank line, then ``[Source: f]\\ntext`` blocks in
    (stage, rank) order joined by blank lines; one row per question.
    ``manifest`` has one row per ``by`` key (see ``file_manifest``)."""
    from quarry.operators.corpus import clean_filename
    name = F.coalesce(F.nullif(clean_filename(X.basename(F.col("source"))), F.lit("")), F.lit("unknown"))
    rows = hits.join(chunks.select("chunk_id", "text"), "chunk_id").select(
        "qid", by, F.struct("stage", "rank", F.concat(F.lit("[Source: "), name, F.lit("]\n"),
                                                        F.col("text")).alias("block")).alias("s"))
    ctx = rows.groupBy("qid", by).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("s")), lambda s: s["block"]), "\n\n").alias("body"))
    return (ctx.join(manifest.select(by, "name"), by, "left")
            .select("qid", by, F.concat(F.coalesce(F.col("name"), F.lit("(no files indexed)")),
                                        F.lit("\n\n"), F.col("body")).alias("context")))


def retrieve_in_session(questions: DataFrame, chunks: DataFrame, scope: str = "session_id", base_k: int = 5,
                        per_source: int = 2, broad_cap: int = 60) -> DataFrame:
    """R2 over lexical scores, each question in its own session: route it, set k
    from the session's chunk count, take the k best chunks (stage 0) and the
    best ones of each source of the session that is absent from them (stage 1).
    Questions about the file list or about table figures need no chunks."""
    from quarry.operators.corpus import distinct_sources
    asked = route(questions).where(F.col("route").isin("broad", "specific"))
    asked = adaptive_k(asked, distinct_sources(chunks, scope), base_k=base_k, broad_cap=broad_cap, by=scope)
    order = [F.col("score").desc(), F.col("chunk_id")]
    keep = max(broad_cap, per_source)
    best = top_k(bm25_in_scope(asked, chunks, scope, k=keep, group="source"), keep, ["qid", scope, "source"], order, "_r").drop("_r")
    scored = with_chunk_rows(best, chunks, scope).join(asked.select("qid", "route", "k"), "qid")
    return hits_with_coverage(scored, broad_cap, per_source, order, k_col="k").select(
        "qid", scope, "route", "stage", "rank", "chunk_id", "source", "score")


def with_chunk_rows(best: DataFrame, chunks: DataFrame, *scope: str) -> DataFrame:
    """``best(chunk_id, source, ...)`` once for every row of ``chunks`` with that
    id and source; none for a null id."""
    rows = chunks.select(*[F.col(c).alias(f"_{c}") for c in (*scope, "chunk_id", "source")])
    same = F.col("source").eqNullSafe(F.col("_source"))
    for c in (*scope, "chunk_id"):
        same &= F.col(c) == F.col(f"_{c}")
    return best.join(rows, same).select(*best.columns)


def strip_source_tags(c):
    """``[Source: x]`` -> ``x``; collapse runs of blanks; no blank before
    ``.,;:)`` or a newline; strip."""
    s = F.regexp_replace(c, r"\s*\[Source:\s*([^\]]+?)\s*\]\s*", " $1 ")
    s = F.regexp_replace(s, r"[ \t]{2,}", " ")
    s = F.regexp_replace(s, r" +([.,;:)\n])", "$1")
    return X.strip(s)


def hits_with_coverage(scored: DataFrame, k: int, per_source: int, order: list, source: str = "source",
                       item_id: str = "chunk_id", k_col: str | None = None) -> DataFrame:
    """R2/U1 in one linear pass over scored (qid, source, item) rows: the
    overall top-k (stage 0) and, for each source absent from it, that
    source's best ``per_source`` items (stage 1, ranked by source then
    order). The overall top-k is a subset of the per-source top-k, so one
    per-(question, source) rank filter feeds both stages and the scored
    input is consumed once. ``k_col`` names a column with the question's own
    k, of which ``k`` is the greatest possible."""
    keep = max(k, per_source)
    k_of = F.col(k_col) if k_col else F.lit(k)
    ps = top_k(scored, keep, ["qid", source], order, "rs")
    w_all = Window.partitionBy("qid").orderBy(*order)
    ps = ps.withColumn("r", F.row_number().over(w_all))
    present = F.max(F.when(F.col("r") <= k_of, 1)).over(Window.partitionBy("qid", source))
    ps = ps.withColumn("present", present)
    stage0 = F.col("r") <= k_of
    cover = F.col("present").isNull() & (F.col("rs") <= per_source)
    sel = ps.where(stage0 | cover).withColumn("stage", F.when(stage0, 0).otherwise(1))
    w_stage = Window.partitionBy("qid", "stage").orderBy(
        F.when(F.col("stage") == 1, F.col(source)), *order)
    return sel.withColumn("rank", F.row_number().over(w_stage)).drop("rs", "r", "present")
