"""Registered answer and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evals as EV
from quarry.operators import retrieve as R
from quarry.plans import fixtures as FX
from quarry.plans import q_retrieve as QR
from quarry.plans import sqlfrag as S
from quarry.plans.registry import query

EVAL_K = 10
SENT_SPLIT = r"[.!?\n]+\s*"

_HITS_SQL = QR._BM25[:-1] + f""",
top AS (SELECT * FROM (SELECT s.qid, s.chunk_id, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC,
    s.chunk_id) AS rank FROM scores s) WHERE rank <= {QR.CONTEXT_K}),
sent AS (SELECT qid, rank, pos, s FROM (
    SELECT t.qid, t.rank, unnest(range(len(parts))) AS pos, unnest(parts) AS s FROM top t
    JOIN (SELECT chunk_id, string_split_regex(text, '{SENT_SPLIT.replace(chr(92) + 'n', chr(92) + 'n')}') AS parts
          FROM chunks) c ON t.chunk_id = c.chunk_id) WHERE {S.strip('s')} <> ''),
qtok AS (SELECT qid, list_distinct({S.tokens('question')}) AS qt FROM bq),
scored AS (SELECT se.qid, se.rank, se.pos, {S.strip('se.s')} AS s,
    len(list_intersect(list_distinct({S.tokens('se.s')}), q.qt)) AS score
  FROM sent se JOIN qtok q ON se.qid = q.qid),
answers AS (SELECT qid, string_agg(s, chr(10) ORDER BY rank, pos) AS answer FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos) AS r FROM scored)
  WHERE r <= 3 GROUP BY qid)
"""


def _answers(spark, d):
    ch = FX.corpus_chunks(spark, d)
    qs = FX.bench_questions(spark, d)
    top = R.bm25_top(qs, FX.term_index(spark, d), QR.CONTEXT_K).select("qid", "chunk_id", "rank")
    return EV.extractive_answer(qs, top, ch, SENT_SPLIT), top, ch, qs


@query("extractive_answer", _HITS_SQL + "SELECT qid, answer FROM answers")
def extractive_answer(spark, d):
    """The 3 context sentences sharing most terms with the question,
    in context order (tags stripped by P12)."""
    ans, *_ = _answers(spark, d)
    return ans.select("qid", R.strip_source_tags(F.col("answer")).alias("answer"))


@query("eval_answers", _HITS_SQL[:-1] + f""",
ctx AS (SELECT t.qid, list_distinct(flatten(list({S.tokens('c.text')}))) AS ct
        FROM top t JOIN chunks c ON t.chunk_id = c.chunk_id GROUP BY t.qid),
ctxn AS (SELECT t.qid, flatten(list({S.extract_numbers('c.text')})) AS cn
         FROM top t JOIN chunks c ON t.chunk_id = c.chunk_id GROUP BY t.qid),
m AS (SELECT a.qid, q.qt, list_distinct({S.tokens('a.answer')}) AS atk, x.ct, {S.extract_numbers('a.answer')} AS an,
        n.cn
      FROM answers a JOIN qtok q ON a.qid = q.qid JOIN ctx x ON a.qid = x.qid JOIN ctxn n ON a.qid = n.qid)
SELECT qid,
  round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(atk, qt)) / len(qt) END, 6) AS relevancy,
  round(CASE WHEN len(atk) = 0 THEN 0 ELSE len(list_intersect(atk, ct)) / len(atk) END, 6) AS faithfulness,
  len(an) AS n_numbers,
  len(list_filter(an, lambda a: len(list_filter(cn, lambda c: abs(a - c) < 0.01)) = 0)) AS n_unsupported
FROM m""")
def eval_answers(spark, d):
    """Token-overlap answer relevancy and faithfulness per question
    (pass mark 0.5 is applied by ``evals.pass_rate``) and the count of
    answer numbers the context does not support."""
    ans, top, ch, qs = _answers(spark, d)
    return EV.answer_scores(qs, ans, top, ch).select(
        "qid", "relevancy", "faithfulness", "n_numbers", "n_unsupported")


@query("eval_retrieval", FX.with_(FX.SQL_VECTORS) + f""", pairs AS (
  SELECT q.chunk_id AS qid, q.source AS qlabel, i.chunk_id, i.source, round(list_distance(q.v, i.v), 6) AS dist
  FROM vec q, vec i WHERE q.chunk_id <> i.chunk_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rank FROM pairs)
         WHERE rank <= {EVAL_K}),
lab AS (SELECT source, count(*) AS n FROM vec GROUP BY source),
per_q AS (SELECT h.qid, count(*) FILTER (WHERE h.source = h.qlabel) AS rel,
                 min(CASE WHEN h.source = h.qlabel THEN rank END) AS first_rel, max(l.n) - 1 AS n_rel
          FROM hits h JOIN lab l ON l.source = h.qlabel GROUP BY h.qid)
SELECT count(*) AS n_queries, round(avg(rel / {EVAL_K}), 6) AS precision_at_k,
  round(avg(CASE WHEN n_rel > 0 THEN rel / n_rel ELSE 0 END), 6) AS recall_at_k,
  round(avg(coalesce(1.0 / first_rel, 0)), 6) AS mrr
FROM per_q""".replace("\n, pairs AS", ",\npairs AS", 1))
def eval_retrieval(spark, d):
    """precision@k, recall@k and MRR of exact k-NN over the stored
    vectors (self excluded); relevant = same label."""
    v, q = FX.vectors(spark, d), FX.vector_questions(spark, d)
    hits = R.knn(q, v, EVAL_K + 1).where(F.col("qid") != F.col("chunk_id"))
    hits = R.top_k(hits, EVAL_K, ["qid"], [F.col("dist"), F.col("chunk_id")])
    labels = v.select(F.col("chunk_id").alias("qid"), F.col("source").alias("qlabel"))
    rel = hits.join(v.select("chunk_id", "source"), "chunk_id").join(labels, "qid") \
              .withColumn("relevant", F.col("source") == F.col("qlabel"))
    sizes = v.groupBy(F.col("source").alias("qlabel")).agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    return EV.retrieval_metrics(rel, sizes, EVAL_K)


@query("assemble_prompts", QR._PACK_SQL + """
SELECT p.qid, 'Answer the question from the context below. Name files naturally; use only these files: '
  || (SELECT name FROM manifest) || chr(10) || chr(10) || 'Context:' || chr(10) || p.context || chr(10) || chr(10)
  || 'Question: ' || b.question || chr(10) || 'Answer:' AS prompt
FROM packed p JOIN bq b ON p.qid = b.qid""")
def assemble_prompts(spark, d):
    """Question + manifest + packed context -> prompt text."""
    from quarry.operators.corpus import file_manifest
    all_hits, ch = QR._hits(spark, d)
    man = file_manifest(ch, by="scope")
    packed = R.pack_context(all_hits, ch, man, by="scope")
    return EV.assemble_prompts(packed, FX.bench_questions(spark, d), man, "scope")


@query("batch_infer_cached")
def batch_infer_cached(spark, d):
    """Prompts of R5 through the batch hook, one pass with an empty cache:
    every distinct prompt is computed, and nothing is joined with cached rows."""
    from quarry.operators.infer import batch_infer_cached as bic
    prompts = assemble_prompts(spark, d)
    answers, fresh = bic(prompts, None, "default")
    return answers.select("qid", "key", "output")
