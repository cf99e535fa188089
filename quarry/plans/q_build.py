"""Registered corpus-build queries: recursive chunks, embeddings, LSH, R1."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators import ivf, sparse
from quarry.operators.infer import embed_chunks
from quarry.operators.lsh import knn_lsh as lsh
from quarry.plans import fixtures as FX
from quarry.plans.registry import query
from quarry.session import scratch_path


@query("chunk_recursive")
def chunk_recursive(spark, d):
    """P8 over every document (invariants: chunk <= 1000 chars, text kept in
    order; checked in tests)."""
    return C.chunk_recursive(FX.corpus(spark, d)).select(
        "doc_id", "pos", "chunk_id", F.length("text").alias("n_chars"))


@query("embed_chunks", FX.with_(FX.SQL_CORPUS, FX.SQL_CHUNKS) + r"""
SELECT chunk_id, 4096 AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm
FROM chunks""")
def embed_chunks_q(spark, d):
    """HashingTF-IDF vectors for every fixed chunk; SQL holds their size
    and length (1, or 0 without a token)."""
    e = embed_chunks(FX.chunks(spark, d).select("chunk_id", "text"))
    return e.select("chunk_id", F.size("embedding").alias("dim"),
                    F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


def _sql_sparse(rows: str, name: str, id_col: str, text: str, fit: str) -> str:
    """``name``(id, i, w) of the texts of ``rows``; frequencies are those of ``fit`` (a name given before)."""
    return f"""{name}_t AS (SELECT {id_col}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {sparse.DIMS} AS i, count(*) AS tf FROM (
  SELECT {id_col}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {rows}) GROUP BY ALL),
{name}_d AS (SELECT i, ln(((SELECT count(*) FROM chunks) + 1.0)::DOUBLE / (count(*) + 1)) AS idf FROM {fit}_t GROUP BY i),
{name}_w AS (SELECT {id_col}, i, tf * idf AS w FROM {name}_t JOIN {name}_d USING (i)),
{name} AS (SELECT {id_col}, i, CASE WHEN n > 0 THEN w / n ELSE 0.0 END AS w FROM {name}_w JOIN (
  SELECT {id_col}, sqrt(sum(w * w)) AS n FROM {name}_w GROUP BY {id_col}) USING ({id_col}))"""


def _sparse(spark, d):
    """The chunks with their counted terms, and the frequencies."""
    ch = sparse.count_terms(FX.chunks(spark, d))
    return ch, sparse.fit_idf(ch)


@query("sparse_vectors", FX.with_(FX.SQL_CORPUS, FX.SQL_CHUNKS, _sql_sparse("chunks", "v", "chunk_id", "text", "v")) +
       "SELECT session_id, source, chunk_id, CAST(i AS INTEGER) AS i, round(w, 6) AS weight FROM v JOIN chunks USING (chunk_id)")
def sparse_vectors(spark, d):
    """Every chunk's term weights, written with the corpus by session and
    read back."""
    ch, idf = _sparse(spark, d)
    path = scratch_path(spark, "corpus-vectors")
    sparse.write_vectors(sparse.embed(ch, idf, keep=("doc_id", "source", "session_id", "pos", "text")), path)
    back = spark.read.schema("chunk_id string, source string, indices array<int>, weights array<double>, session_id string").parquet(path)
    return back.select("session_id", "source", "chunk_id", F.inline(F.arrays_zip("indices", "weights"))).select(
        "session_id", "source", "chunk_id", F.col("indices").alias("i"), F.round("weights", 6).alias("weight"))


@query("sparse_nearest", FX.with_(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_KEY_Q, _sql_sparse("chunks", "v", "chunk_id", "text", "v"),
                                  _sql_sparse("kq", "q", "qid", "question", "v")) + """
SELECT qid, chunk_id, dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rank FROM (
    SELECT qid, chunk_id, round(sqrt(greatest(0.0, round(2 - 2 * sum(q.w * v.w), 9))), 6) AS dist FROM q JOIN v USING (i)
    WHERE q.w > 0 AND v.w > 0 GROUP BY qid, chunk_id)) WHERE rank <= 5""")
def sparse_nearest(spark, d):
    """E1 with J3's question: the chunks nearest to short questions by sparse distance."""
    ch, idf = _sparse(spark, d)
    q = sparse.embed(FX.keyword_questions(spark, d), idf, "question", "qid")
    return sparse.nearest(q, sparse.embed(ch, idf), 5).select("qid", "chunk_id", "dist", "rank")


@query("knn_lsh")
def knn_lsh(spark, d):
    """Approximate 10-NN of every stored vector; recall against ``knn_exact`` is asserted in tests."""
    return lsh(FX.vector_questions(spark, d), FX.vectors(spark, d), 10).select("qid", "chunk_id", "dist")


@query("knn_indexed", FX.with_(FX.SQL_VECTORS) + """
SELECT qid, chunk_id, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS r FROM (
    SELECT q.chunk_id AS qid, i.chunk_id, round(list_distance(q.v, i.v), 6) AS dist FROM vec q, vec i))
WHERE r <= 10""")
def knn_indexed(spark, d):
    """10-NN of every stored vector through the partitioned index. Where the
    sample shows no structure, as with independent random vectors, ``ivf.knn`` is
    the exact search; SQL holds its rows."""
    return ivf.knn(FX.vector_questions(spark, d), ivf.build_index(FX.vectors(spark, d)), 10).select("qid", "chunk_id", "dist")


@query("build_corpus", FX.with_(FX.SQL_CORPUS, FX.SQL_CHUNKS) + """
SELECT session_id, min(chunk_id) AS chunk_id, source || '::' || sha256(text) AS fp, 1 AS run
FROM chunks GROUP BY ALL""")
def build_corpus(spark, d):
    """Full build into a fresh corpus table, then an idempotent re-run;
    returns the chunks that each run added (none in the second)."""
    from quarry.operators.build import build_corpus as build
    path = scratch_path(spark, "corpus-build")
    docs = FX.corpus(spark, d)
    runs = [build(spark, docs, path).withColumn("run", F.lit(n)) for n in (1, 2)]
    return runs[0].unionByName(runs[1]).select("session_id", "chunk_id", "fp", "run")
