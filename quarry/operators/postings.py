"""A stored BM25 index, and exact top-k over it by score bounds.

Three tables, written once at ingest from one tokenisation of the corpus:

* ``forward`` - a row a chunk: its length and its terms with their counts. Bucketed
  by chunk, so that the chunks of given pairs are found without a shuffle of the table.
* ``terms`` - a row a term: document frequency, greatest impact, and the number
  of shards. Bucketed by term.
* ``blocks`` - postings, in order of impact, ``BLOCK`` to a row, with the row's
  greatest impact. A term with more than ``SPLIT`` postings is cut into shards.
  Bucketed and sorted by (term, shard). Postings move to them in packs, the postings of a
  term from one Arrow batch of forward rows, which are what is dealt to the shards.

The *impact* of a posting is its BM25 weight without the idf factor,
``tf (k1+1) / (tf + k1 (1 - b + b dl/avgdl))``.

``top`` finds the k best chunks of each question without scoring every chunk
that shares a term with it:

1. The best chunks of the first blocks alone are scored in full; the k-th best of
   these scores is a threshold t that the k-th final score cannot be under.
2. Let the question's terms be in order of their greatest weight, and R_i the sum
   of the greatest weights after the i-th. A chunk whose first term in this order
   is the i-th scores at most w_i + R_i. So a chunk at or above t has, in the list
   of its first term, a weight of t - R_i or more. Only these postings are read:
   blocks below the bound are skipped, and terms too common to reach it are not
   read at all. A posting that was not read is known to be below its bound, so
   chunks whose sum stays under t even with these bounds go, too.
3. The chunks that are left are scored in full from their forward rows.

The result equals that of scoring everything; ties included (``SLACK`` is wider
than the rounding to six places). How much is skipped hangs on the questions: a
few words each leave a few chunks in a hundred; passages of sixty words, whose
many middling weights add up, leave a third or more, and ``scores`` may be cheaper. A question's terms meet the bucketed tables
without a shuffle of the tables; the question side carries a hot term's shards.

That moves the candidate pairs, which grow with questions times chunks. Where over
``MANY`` questions are asked at once, steps 1 to 3 are taken within cells instead
(``_in_shards``): a task holds the postings of one part of the chunks, questions come
past it one by one, and only the k best of a question and a part move on.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.retrieve import _round6, term_tokens, top_k
from quarry.session import scratch_path

BLOCK = 128  # postings in a row
SPLIT = 1 << 16  # postings in a shard of a term, about
BUCKETS = 64
K1, B = 1.2, 0.75
SLACK = 1e-5
TRIED = 4  # times k chunks of the first blocks are scored in full for the threshold
MANY = 2048  # questions, from which on parts of the index come to the questions
PART = 1 << 22  # words of the chunks that a task holds, about
VISIT = 25  # chunks that can be moved and sorted in the time that a question looks through a part, about


def counted_terms(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array: runs of the sorted array."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(s) + 1))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda r: F.struct(
            F.element_at(s, r["a"]).alias("term"), (r["z"] - r["a"]).alias("tf")))
    sorted_once = F.element_at(F.transform(F.array(F.array_sort(tokens)), lambda s: F.when(F.size(s) > 0, runs(s))), 1)
    return F.coalesce(sorted_once, F.array().cast("array<struct<term:string,tf:int>>"))


class StoredIndex:
    """The three tables, the number of chunks and their average length."""

    def __init__(self, forward: DataFrame, terms: DataFrame, blocks: DataFrame, n: int, avgdl: float, stem: bool):
        self.forward, self.terms, self.blocks, self.n, self.avgdl, self.stem = forward, terms, blocks, n, avgdl, stem

    def impact(self, tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.avgdl or 1.0)))

    def asked(self, questions: DataFrame, text_col: str = "question") -> DataFrame:
        """(qid, term, idf, top, shards) of the questions' terms that the index has."""
        asked = questions.select("qid", F.explode(F.array_distinct(term_tokens(F.col(text_col), self.stem))).alias("term"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(self.terms, "term").select("qid", "term", idf.alias("idf"), "top", "shards")

    def _postings(self, asked: DataFrame, keep: Column) -> DataFrame:
        """(qid, chunk_id, w) of the asked terms' postings in the blocks that
        ``keep`` lets through (over ``asked`` and the blocks' columns)."""
        sharded = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        met = sharded.join(self.blocks, ["term", "shard"]).where(keep)
        extra = [c for c in ("bound", "unread", "need") if c in asked.columns]
        return met.select("qid", "idf", *extra, F.inline("postings")).withColumn("w", F.col("idf") * F.col("impact"))

    def scores(self, questions: DataFrame, text_col: str = "question") -> DataFrame:
        """All (qid, chunk_id, score): every chunk that shares a term."""
        return _summed(self._postings(self.asked(questions, text_col), F.lit(True)))

    def pair_scores(self, questions: DataFrame, pairs: DataFrame, text_col: str = "question") -> DataFrame:
        """Scores of given (qid, chunk_id) pairs, from the forward rows; pairs
        that share no term are not in it."""
        return self._pairs(self.asked(questions, text_col).select("qid", "term", "idf"), pairs)

    def _pairs(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        rows = pairs.select("qid", "chunk_id").join(self.forward, "chunk_id").select("qid", "chunk_id", "dl", F.inline("terms"))
        return _summed(rows.join(asked, ["qid", "term"]).select("qid", "chunk_id", (F.col("idf") * self.impact(F.col("tf"), F.col("dl"))).alias("w")))

    def candidates(self, questions: DataFrame, k: int, text_col: str = "question") -> DataFrame:
        """(qid, chunk_id): every chunk that can be among the k best (steps 1 and 2)."""
        return self._candidates(self.asked(questions, text_col), k)

    def _candidates(self, asked: DataFrame, k: int) -> DataFrame:
        heads = self._postings(asked, F.col("block") == 0).groupBy("qid", "chunk_id").agg(F.sum("w").alias("w"))
        tried = top_k(heads, TRIED * k, ["qid"], [F.col("w").desc(), F.col("chunk_id")], "r")
        known = top_k(self._pairs(asked.select("qid", "term", "idf"), tried), k, ["qid"], [F.col("score").desc()], "r")
        least = known.where(F.col("r") == k).select("qid", (F.col("score") - SLACK).alias("t"))  # fewer than k: no threshold
        most = F.col("idf") * F.col("top")
        after = Window.partitionBy("qid").orderBy(most.desc(), "term").rowsBetween(1, Window.unboundedFollowing)
        rest = F.coalesce(F.sum(most).over(after), F.lit(0.0))
        bounded = asked.withColumn("rest", rest).join(least, "qid", "left").select(
            "qid", "term", "idf", "shards", most.alias("most"), (F.coalesce("t", F.lit(0.0)) - F.col("rest")).alias("bound"), "t")
        # a posting that is not read weighs less than this
        unread = F.greatest(F.least("most", "bound"), F.lit(0.0))
        bounded = bounded.withColumn("unread", unread).withColumn("need", F.col("t") - F.sum("unread").over(Window.partitionBy("qid")))
        found = self._postings(bounded.where(F.col("most") >= F.col("bound")), F.col("idf") * F.col("top_of_block") >= F.col("bound"))
        return found.where(F.col("w") >= F.col("bound")).groupBy("qid", "chunk_id").agg(
            F.sum(F.col("w") - F.col("unread")).alias("above"), F.first("need").alias("need")).where(
            F.col("need").isNull() | (F.col("above") >= F.col("need"))).select("qid", "chunk_id")

    def top(self, questions: DataFrame, k: int, text_col: str = "question") -> DataFrame:
        """(qid, chunk_id, score, rank): the k best, ties by chunk id."""
        asked = self.asked(questions, text_col)
        n = questions.count()
        scored = (self._in_shards(asked.select("qid", "term", "idf"), n, k) if n > MANY else
                  self._pairs(asked.select("qid", "term", "idf"), self._candidates(asked, k)))
        return top_k(scored, k, ["qid"], [F.col("score").desc(), F.col("chunk_id")])


    def _in_shards(self, asked: DataFrame, n_asked: int, k: int) -> DataFrame:
        """(qid, chunk_id, score) of chunks that can be among a question's k best.

        Parts of the chunks meet blocks of questions in the cells of a grid. A part
        is small enough for a task to hold; how many there are beyond that weighs
        the copies of questions against those of chunks. At most k rows a question
        and part come out."""
        spark = self.forward.sparkSession
        cells = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        n_i = max(1, -(-int(self.n * max(self.avgdl, 1.0)) // PART), min(cells, int((cells * self.n / (VISIT * max(n_asked, 1))) ** 0.5)))
        n_q = -(-cells // n_i)
        q_type, i_type, none = asked.schema["qid"].dataType, self.forward.schema["chunk_id"].dataType, F.lit(None)

        def dealt(df, own, other, n_own, n_other, key, is_item, cols):
            return df.where(F.col(key).isNotNull()).select(
                F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own), F.lit(not is_item).alias("_asks"), *cols,
                F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
        # rows of an id that is there several times count each
        words = asked.groupBy("qid", "term").agg(F.sum("idf").alias("idf")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("w"))
        q = dealt(words, "_qb", "_ib", n_q, n_i, "qid", False, [
            F.col("qid").alias("_q"), none.cast(i_type).alias("_i"), none.cast("long").alias("_l"), F.col("w.term").alias("_t"),
            none.cast("array<int>").alias("_n"), F.col("w.idf").alias("_w")])
        i = dealt(self.forward.where(F.size("terms") > 0), "_ib", "_qb", n_i, n_q, "chunk_id", True, [
            none.cast(q_type).alias("_q"), F.col("chunk_id").alias("_i"), F.col("dl").alias("_l"), F.col("terms.term").alias("_t"),
            F.col("terms.tf").alias("_n"), none.cast("array<double>").alias("_w")])
        grid = q.unionByName(i).withColumn("_c", F.col("_qb") * n_i + F.col("_ib")).repartitionById(n_i * n_q, F.col("_c"))
        grid = grid.sortWithinPartitions("_c", "_asks", "_i").select("_c", "_asks", "_q", "_i", "_l", "_t", "_n", "_w")
        res = T.StructType([T.StructField("qid", q_type), T.StructField("chunk_id", i_type), T.StructField("score", T.DoubleType())])
        return grid.mapInArrow(_searched_parts(k, self.avgdl), res)


def _searched_parts(k: int, avgdl: float):
    def runs(batches):
        """(cell, questions or chunks, rows): neighbours of one kind, in order."""
        for rows in batches:
            if rows.num_rows:
                cell, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                cut = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip([0, *cut], [*cut, rows.num_rows]):
                    yield int(cell[lo]), bool(asks[lo]), rows.slice(lo, hi - lo)

    def run(batches):
        at, chunks, part = None, [], None
        for cell, asks, rows in runs(batches):
            if cell != at:
                at, chunks, part = cell, [], None
            if not asks:
                chunks.append([rows.column(c) for c in (3, 4, 5, 6)])
            elif chunks or part:
                if part is None:
                    part, chunks = _Part(chunks, avgdl), []
                yield part.top(rows, k)
    return run


class _Part:
    """Postings of a part of the chunks, which come in the order of their ids: for
    each word its chunks by place, with their impacts, and the greatest of these."""

    LATE = 2  # words of a question, those in most chunks, that are left out if they cannot matter

    def __init__(self, chunks: list, avgdl: float):
        ids, dl, terms, tfs = ([c[j] for c in chunks] for j in range(4))
        of_row = np.concatenate([np.repeat(np.arange(len(t)), pc.list_value_length(t).to_numpy(zero_copy_only=False)) + at
                                 for t, at in zip(terms, np.cumsum([0, *map(len, terms)]))])
        ids = pa.concat_arrays(ids)
        words = pa.concat_arrays([t.flatten() for t in terms]).dictionary_encode()
        self.words = {w: c for c, w in enumerate(words.dictionary.to_pylist())}
        code = words.indices.to_numpy(zero_copy_only=False)
        tf = np.concatenate([t.flatten().to_numpy(zero_copy_only=False) for t in tfs]).astype(float)
        dl = np.concatenate([x.to_numpy(zero_copy_only=False) for x in dl])[of_row]
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))
        new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        place = np.cumsum(np.r_[False, new])[of_row]  # rows of one id are one chunk
        self.ids = ids.take(pa.array(np.flatnonzero(np.r_[True, new])))
        order = np.lexsort((place, code))
        code, place, impact = code[order], place[order], impact[order]
        one = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (place[1:] != place[:-1])])
        self.place, self.impact = place[one], np.add.reduceat(impact, one)
        self.at = np.searchsorted(code[one], np.arange(len(self.words) + 1))
        self.most = np.maximum.reduceat(self.impact, self.at[:-1])
        self.first = np.zeros(len(self.ids), dtype=np.int64)

    def top(self, rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k best chunks of each question (rows: its words with their idf)."""
        length = pc.list_value_length(rows.column(5)).to_numpy(zero_copy_only=False)
        code = np.array([self.words.get(w, -1) for w in rows.column(5).flatten().to_pylist()], dtype=np.int64)
        idf = rows.column(7).flatten().to_numpy(zero_copy_only=False)
        end = np.cumsum(length)
        found = [self.best(code[a:z][code[a:z] >= 0], idf[a:z][code[a:z] >= 0], k) for a, z in zip(end - length, end)]
        of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        return pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(of)), self.ids.take(pa.array(np.concatenate([f[0] for f in found]))),
                                           pa.array(np.concatenate([f[1] for f in found]))], ["qid", "chunk_id", "score"])

    def best(self, code, idf, k):
        """(places, scores) of the k best chunks, ties to the smaller id. Words go
        from the rarest to the commonest. Before each of the last ones: if the k-th
        best sum is over all that the rest can add up to, only chunks that were met
        count, and of these the ones that can reach it."""
        if not len(code):
            return np.empty(0, np.int64), np.empty(0)
        order = np.argsort(self.at[code + 1] - self.at[code], kind="stable")
        code, idf = code[order], idf[order]
        rest = np.r_[np.cumsum((idf * self.most[code])[::-1])[::-1], 0.0]  # what the words from this one on can add
        j = max(1, len(code) - self.LATE)
        some, score = self.summed([self.postings(c, i) for c, i in zip(code[:j], idf[:j])])
        while j < len(code):
            least = self.least(score, k)
            if least > rest[j]:
                break
            some, score = self.summed([(some, score), self.postings(code[j], idf[j])])
            j += 1
        for j in range(j, len(code)):
            near = score + rest[j] >= least
            some, score = some[near], score[near]
            place, weight = self.postings(code[j], 1.0)
            at = np.searchsorted(place, some)
            at[at == len(place)] = 0
            score += np.where(place[at] == some, idf[j] * weight[at], 0.0)
            least = max(least, self.least(score, k))
        near = score >= self.least(score, k)
        some, score = some[near], _round6(score[near])
        first = np.lexsort((some, -score))[:k]
        return some[first], score[first]

    def postings(self, code, idf):
        a, z = self.at[code], self.at[code + 1]
        return self.place[a:z], self.impact[a:z] if idf == 1.0 else idf * self.impact[a:z]

    def summed(self, lists):
        """The different places of the lists, and the sums of their weights."""
        place = np.concatenate([x[0] for x in lists])
        at = np.arange(len(place))
        self.first[place] = at  # one of each place's rows stands for it
        own = self.first[place]
        sums = np.bincount(own, np.concatenate([x[1] for x in lists]), len(place))
        kept = own == at
        return place[kept], sums[kept]

    @staticmethod
    def least(score, k):
        """What the k-th best cannot be under."""
        return np.partition(score, len(score) - k)[len(score) - k] - SLACK if len(score) >= k else -1.0


def _summed(weights: DataFrame) -> DataFrame:
    return weights.groupBy("qid", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))


def _bucketed(df: DataFrame, by: list[str], buckets: int, path: str) -> DataFrame:
    """``df`` as an external table at ``path``, bucketed and sorted by ``by``."""
    spark = df.sparkSession
    name = f"quarry_{path.rstrip('/').split('/')[-1].replace('-', '_')}_{uuid.uuid4().hex[:8]}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    return spark.table(name)


def forward_rows(chunks: DataFrame, stem: bool = False) -> DataFrame:
    tokens = chunks.select("chunk_id", term_tokens(F.col("text"), stem).alias("toks"))
    return tokens.select("chunk_id", F.size("toks").cast("long").alias("dl"), counted_terms(F.col("toks")).alias("terms"))


def _packs(avgdl: float, most: int):
    """(term, n, top, ids, tfs, dls): the postings of a term in a batch of forward rows, ``most`` to a row."""
    def run(batches):
        for rows in batches:
            of_row, entries = pc.list_parent_indices(rows.column(2)).to_numpy(zero_copy_only=False), rows.column(2).flatten()
            if not len(of_row):
                continue
            term, tf = entries.field(0).dictionary_encode(), entries.field(1).to_numpy(zero_copy_only=False)
            code = term.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code, of_row, tf = code[order], of_row[order], tf[order]
            dl = rows.column(1).to_numpy(zero_copy_only=False)[of_row]
            impact = tf.astype(float) * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
            cuts = np.flatnonzero(place % most == 0)
            ends = np.r_[cuts, len(code)]
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), v) for v in (
                rows.column(0).take(pa.array(of_row)), pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([
                term.dictionary.take(pa.array(code[cuts])), pa.array(np.diff(ends).astype(np.int64)), pa.array(np.maximum.reduceat(impact, cuts)), *lists],
                ["term", "n", "top", "ids", "tfs", "dls"])
    return run


def build_index(chunks: DataFrame, stem: bool = False, path: str | None = None, block: int = BLOCK, split: int = SPLIT,
                buckets: int = BUCKETS) -> StoredIndex:
    """Write the index of ``chunks(chunk_id, text)`` below ``path`` (default: a
    fresh folder of the shared checkpoint folder)."""
    spark: SparkSession = chunks.sparkSession
    path = path or scratch_path(spark, "bm25")
    dealt = chunks.select("chunk_id", "text").repartition(buckets, "chunk_id")  # texts are smaller than their counted terms
    forward = _bucketed(forward_rows(dealt, stem), ["chunk_id"], buckets, f"{path}/forward")
    size = forward.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    index = StoredIndex(forward, None, None, size["n"], size["avgdl"] or 0.0, stem)
    id_type = forward.schema["chunk_id"].dataType.simpleString()
    packs = forward.select("chunk_id", "dl", "terms").mapInArrow(
        _packs(index.avgdl, max(1, split // 8)), f"term string, n long, top double, ids array<{id_type}>, tfs array<int>, dls array<long>")
    df = F.sum("n")
    index.terms = _bucketed(packs.groupBy("term").agg(df.alias("df"), F.max("top").alias("top")).select(
        "term", "df", "top", F.ceil(F.col("df") / F.lit(split)).cast("int").alias("shards")).repartition(buckets, "term"), ["term"], buckets, f"{path}/terms")
    hot = index.terms.where("shards > 1").select("term", "shards")
    # a hot term has over ``split`` postings, so there are few: they go to the packs
    dealt = packs.join(F.broadcast(hot), "term", "left") if not hot.isEmpty() else packs.withColumn("shards", F.lit(1))
    own = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("shards"))
    dealt = dealt.select("term", "ids", "tfs", "dls", F.when(F.col("shards") > 1, own).otherwise(0).cast("int").alias("shard")).repartition(buckets, "term", "shard")
    weighed = F.transform(F.arrays_zip("ids", "tfs", "dls"), lambda p: F.struct((-index.impact(p["tfs"], p["dls"])).alias("less"), p["ids"].alias("chunk_id")))
    ranked = F.sort_array(F.flatten(F.collect_list(weighed)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ranked") - 1) / block).cast("int")), lambda b: F.slice("ranked", b * block + 1, block))
    rows = dealt.groupBy("term", "shard").agg(ranked.alias("ranked")).select("term", "shard", F.posexplode(cut).alias("block", "part"))
    rows = rows.select("term", "shard", "block", (-F.col("part")[0]["less"]).alias("top"), F.transform(
        "part", lambda p: F.struct(p["chunk_id"].alias("chunk_id"), (-p["less"]).alias("impact"))).alias("postings"))
    index.blocks = _bucketed(rows, ["term", "shard"], buckets, f"{path}/blocks").withColumnRenamed("top", "top_of_block")
    return index
