"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.operators import retrieve as R
from quarry.operators.postings import forward_rows
from quarry.plans import fixtures as FX
from quarry.plans.registry import query
from quarry.session import scratch_path

W = FX.with_

# Parameters of the registered retrieval queries.
BM25_K = 10
CONTEXT_K = 3
KNN_K = 10
STAGE1_K = 5
MMR_K, MMR_FETCH = 5, 20
STD_BASE_K = 5
TWO_PASS_MIN_SCORE = 60.0
TWO_PASS_K = 5
RERANK_POOL, RERANK_N = 20, 6

_BM25 = W(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_BENCH_Q, FX.bm25_sql("bq"))


def _chunks_all(spark, d):
    return FX.corpus_chunks(spark, d).withColumn("scope", F.lit("all"))


@query("bm25_candidates", _BM25 + f"""
SELECT qid, rank, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scores)
WHERE rank <= {BM25_K}""")
def bm25_candidates(spark, d):
    return R.bm25_top(FX.bench_questions(spark, d), FX.term_index(spark, d), BM25_K) \
            .select("qid", "rank", "chunk_id", "score")


@query("topk_per_question", _BM25 + f"""
SELECT s.qid, s.rank, s.chunk_id, c.source, s.score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scores) s
JOIN chunks c ON c.chunk_id = s.chunk_id
WHERE s.rank <= {CONTEXT_K}""")
def topk_per_question(spark, d):
    ch = FX.corpus_chunks(spark, d)
    hits = R.bm25_top(FX.bench_questions(spark, d), FX.term_index(spark, d), CONTEXT_K)
    return hits.join(ch.select("chunk_id", "source"), "chunk_id") \
               .select("qid", "rank", "chunk_id", "source", "score")


@query("bm25_topk_stored", W(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_KEY_Q, FX.bm25_sql("kq")) + f"""
SELECT qid, rank, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scores)
WHERE rank <= {BM25_K}""")
def bm25_topk_stored(spark, d):
    """J9/T1 by score bounds over the bucketed index: short questions, the same
    rows as scoring every chunk."""
    return FX.stored_index(spark, d).top(FX.keyword_questions(spark, d), BM25_K) \
             .select("qid", "rank", "chunk_id", "score")


_KNN = W(FX.SQL_VECTORS, """pairs AS (
  SELECT q.chunk_id AS qid, i.chunk_id, i.source, round(list_distance(q.v, i.v), 6) AS dist
  FROM vec q, vec i)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS r FROM pairs)""",
             """per_src AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY dist, chunk_id) AS rs
                 FROM pairs) WHERE rs <= 2)""")


@query("knn_exact", _KNN + f"SELECT qid, chunk_id, dist FROM ranked WHERE r <= {KNN_K}")
def knn_exact(spark, d):
    return R.knn(FX.vector_questions(spark, d), FX.vectors(spark, d), KNN_K) \
            .select("qid", "chunk_id", "dist")


def _stage1(spark, d):
    v = FX.vectors(spark, d)
    hits = R.knn(FX.vector_questions(spark, d), v, STAGE1_K).join(v.select("chunk_id", "source"), "chunk_id")
    best = R.knn(FX.vector_questions(spark, d), v, 2, group="source")
    return hits, best


@query("missing_sources", _KNN + f"""
SELECT DISTINCT qid, source FROM per_src
WHERE (qid, source) NOT IN (SELECT (qid, source) FROM ranked WHERE r <= {STAGE1_K})""")
def missing_sources(spark, d):
    hits, best = _stage1(spark, d)
    return R.missing_sources(hits, best)


_COVER_SQL = f"""cover AS (
  SELECT qid, chunk_id, source, dist,
         row_number() OVER (PARTITION BY qid ORDER BY source, dist, chunk_id) AS rank
  FROM per_src p
  WHERE NOT EXISTS (SELECT 1 FROM ranked h WHERE h.r <= {STAGE1_K} AND h.qid = p.qid
                    AND h.source = p.source))"""


@query("source_coverage", _KNN[:-1] + ",\n" + _COVER_SQL + "\nSELECT qid, rank, chunk_id, source, dist FROM cover")
def source_coverage(spark, d):
    hits, best = _stage1(spark, d)
    return R.coverage(hits, best).select("qid", "rank", "chunk_id", "source", "dist")


@query("retrieve_with_coverage", _KNN[:-1] + ",\n" + _COVER_SQL + f"""
SELECT qid, 0 AS stage, r AS rank, chunk_id, source, dist FROM ranked WHERE r <= {STAGE1_K}
UNION ALL SELECT qid, 1 AS stage, rank, chunk_id, source, dist FROM cover""")
def retrieve_with_coverage(spark, d):
    hits, best = _stage1(spark, d)
    hits = R.top_k(hits, STAGE1_K, ["qid"], [F.col("dist"), F.col("chunk_id")])
    cov = R.coverage(hits, best)
    cols = ["qid", "stage", "rank", "chunk_id", "source", "dist"]
    return (hits.withColumn("stage", F.lit(0)).select(*cols)
            .unionByName(cov.withColumn("stage", F.lit(1)).select(*cols)))


def mmr_sql(k: int, fetch_k: int, pool_from: str = "ranked") -> str:
    """DuckDB CTE chain unrolling the greedy MMR loop ``k`` times."""
    parts = [f"""pool AS (SELECT p.qid, p.chunk_id, p.dist, i.v, q.v AS qv FROM {pool_from} p
  JOIN vec i ON p.chunk_id = i.chunk_id JOIN vec q ON p.qid = q.chunk_id WHERE p.r <= {fetch_k})""",
             """simq AS (SELECT qid, chunk_id, dist, v, round(list_dot_product(v, qv) /
  (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS sq FROM pool)""",
             """chosen1 AS (SELECT qid, chunk_id, 1 AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM simq) WHERE rn = 1)"""]
    for j in range(2, k + 1):
        parts.append(f"""step{j} AS (
  SELECT s.qid, s.chunk_id, round(0.5 * s.sq - 0.5 * max(round(list_dot_product(s.v, c.v) /
         (sqrt(list_dot_product(s.v, s.v)) * sqrt(list_dot_product(c.v, c.v))), 6)), 6) AS score
  FROM simq s JOIN chosen{j - 1} ch ON s.qid = ch.qid
  JOIN simq c ON c.qid = ch.qid AND c.chunk_id = ch.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM chosen{j - 1} x WHERE x.qid = s.qid AND x.chunk_id = s.chunk_id)
  GROUP BY s.qid, s.chunk_id, s.sq)""")
        parts.append(f"""chosen{j} AS (SELECT * FROM chosen{j - 1} UNION ALL
  SELECT qid, chunk_id, {j} AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rn FROM step{j}) WHERE rn = 1)""")
    parts.append(f"""mmr AS (SELECT c.qid, c.rank, c.chunk_id, s.dist FROM chosen{k} c
  JOIN simq s ON s.qid = c.qid AND s.chunk_id = c.chunk_id)""")
    return ",\n".join(parts)


@query("mmr_rerank", _KNN[:-1] + ",\n" + mmr_sql(MMR_K, MMR_FETCH) +
       "\nSELECT qid, rank, chunk_id, dist FROM mmr")
def mmr_rerank(spark, d):
    v, q = FX.vectors(spark, d), FX.vector_questions(spark, d)
    pool = R.knn(q, v, MMR_FETCH)
    return R.mmr(pool, q, v, MMR_K).select("qid", "rank", "chunk_id", "dist")


def _std_k(total: int, base_k: int = STD_BASE_K) -> tuple[int, int]:
    k = max(1, min(total, max(base_k, 16)))
    return k, max(20, 4 * k)


def _std_sql():
    # 500+ vectors at every scale: k = min(total, max(5, 16)) = 16, fetch_k = 64.
    k, fetch = 16, 64
    cover = """cover AS (
  SELECT qid, chunk_id, source, dist,
         row_number() OVER (PARTITION BY qid ORDER BY source, dist, chunk_id) AS rank
  FROM per_src p
  WHERE NOT EXISTS (SELECT 1 FROM mmr m JOIN vec i ON m.chunk_id = i.chunk_id
                    WHERE m.qid = p.qid AND i.source = p.source))"""
    return (_KNN[:-1] + ",\n" + mmr_sql(k, fetch) + ",\n" + cover + """
SELECT m.qid, 0 AS stage, m.rank, m.chunk_id, i.source, m.dist FROM mmr m JOIN vec i ON m.chunk_id = i.chunk_id
UNION ALL SELECT qid, 1 AS stage, rank, chunk_id, source, dist FROM cover""")


@query("retrieve_standard", _std_sql())
def retrieve_standard(spark, d):
    """R2 on stored vectors: adaptive k (specific question), MMR over fetch_k,
    per-source coverage, stage 0 then stage 1."""
    v, q = FX.vectors(spark, d), FX.vector_questions(spark, d)
    total = v.count()
    k, fetch = _std_k(total)
    pool = R.knn(q, v, fetch).join(v.select("chunk_id", "source"), "chunk_id")
    picked = R.mmr(pool, q, v, k, keep=["source"])
    path = scratch_path(spark, "picked")  # read twice: as stage 0 and for what it lacks
    picked.write.parquet(path)
    picked = spark.read.schema(picked.schema).parquet(path)
    best = R.knn(q, v, 2, group="source")
    cov = R.coverage(picked, best)
    cols = ["qid", "stage", "rank", "chunk_id", "source", "dist"]
    return (picked.withColumn("stage", F.lit(0)).select(*cols)
            .unionByName(cov.withColumn("stage", F.lit(1)).select(*cols)))


@query("route_questions", W(FX.SQL_ROUTED_Q) + f"""
SELECT qid, CASE WHEN regexp_matches(question, '{R.FILE_LIST_RE[4:]}', 'i') THEN 'file_list'
                 WHEN regexp_matches(question, '{R.COMPUTE_RE[4:]}', 'i') THEN 'table_compute'
                 WHEN regexp_matches(question, '{R.BROAD_RE[4:]}', 'i') THEN 'broad'
                 ELSE 'specific' END AS route
FROM rq""")
def route_questions(spark, d):
    return R.route(FX.routed_questions(spark, d)).select("qid", "route")


@query("adaptive_k", W(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_ROUTED_Q) + f"""
SELECT qid, k, greatest(20, k * 4) AS fetch_k FROM (
  SELECT rq.qid, greatest(1, CASE WHEN regexp_matches(rq.question, '{R.BROAD_RE[4:]}', 'i')
                                   THEN least(t.n, 60) ELSE least(t.n, greatest({STD_BASE_K}, 16)) END) AS k
  FROM rq JOIN (SELECT session_id, count(*) AS n FROM chunks GROUP BY session_id) t
    ON rq.session_id = t.session_id)""")
def adaptive_k(spark, d):
    totals = C.distinct_sources(FX.chunks(spark, d))
    return R.adaptive_k(FX.routed_questions(spark, d), totals, base_k=STD_BASE_K) \
            .select("qid", "k", "fetch_k")


_PACK_SQL = _BM25[:-1] + f""",
ranked AS (SELECT s.qid, s.chunk_id, c.source, s.score,
                  row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.chunk_id) AS r
           FROM scores s JOIN chunks c ON c.chunk_id = s.chunk_id),
per_src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source
            ORDER BY score DESC, chunk_id) AS rs FROM ranked) WHERE rs <= 2),
cover AS (SELECT qid, chunk_id, source, score,
                 row_number() OVER (PARTITION BY qid ORDER BY source, score DESC, chunk_id) AS rank
          FROM per_src p WHERE NOT EXISTS (SELECT 1 FROM ranked h WHERE h.r <= {CONTEXT_K}
                                           AND h.qid = p.qid AND h.source = p.source)),
hits AS (SELECT qid, 0 AS stage, r AS rank, chunk_id, source FROM ranked WHERE r <= {CONTEXT_K}
         UNION ALL SELECT qid, 1, rank, chunk_id, source FROM cover),
manifest AS (SELECT CAST(count(*) AS VARCHAR) || ' file(s): ' || string_agg(n, ', ' ORDER BY n) AS name
             FROM (SELECT DISTINCT regexp_replace(source, '_[0-9a-f]{{6}}(\\.[^.]+)$', '\\1') AS n FROM chunks)),
packed AS (SELECT h.qid, 'all' AS scope, (SELECT name FROM manifest) || chr(10) || chr(10) ||
                  string_agg('[Source: ' || h.source || ']' || chr(10) || c.text, chr(10) || chr(10)
                             ORDER BY h.stage, h.rank) AS context
           FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY h.qid)
"""


def _hits(spark, d):
    """Benchmark questions: BM25 top-3 (stage 0) + per-source coverage
    (stage 1), with the chunks they point at; BM25 is evaluated once."""
    ch = _chunks_all(spark, d)
    qs = FX.bench_questions(spark, d)
    order = [F.col("score").desc(), F.col("chunk_id")]
    best = R.top_k(R.bm25_indexed(qs, FX.term_index(spark, d), k=CONTEXT_K, group="source"), CONTEXT_K, ["qid", "source"], order)
    hits = R.hits_with_coverage(R.with_chunk_rows(best.drop("rank"), ch), CONTEXT_K, 2, order)
    cols = ["qid", "stage", "rank", "chunk_id", "source"]
    return hits.select(*cols).withColumn("scope", F.lit("all")), ch


def _packed(spark, d):
    all_hits, ch = _hits(spark, d)
    manifest = C.file_manifest(ch, by="scope")
    return R.pack_context(all_hits, ch, manifest, by="scope")


@query("pack_context", _PACK_SQL + "SELECT qid, scope, context FROM packed")
def pack_context(spark, d):
    return _packed(spark, d).select("qid", "scope", "context")


_SESSION_SQL = W(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_ROUTED_Q, FX.SQL_SESSION_Q, rf"""asked AS (
  SELECT *, CASE WHEN regexp_matches(question, '{R.BROAD_RE[4:]}', 'i') THEN 'broad' ELSE 'specific' END AS route
  FROM sq WHERE NOT regexp_matches(question, '{R.FILE_LIST_RE[4:]}', 'i')
            AND NOT regexp_matches(question, '{R.COMPUTE_RE[4:]}', 'i')),
ct AS (SELECT session_id, chunk_id, source, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS toks FROM chunks),
st AS (SELECT session_id, count(*) AS n, avg(len(toks)) AS avgdl FROM ct GROUP BY session_id),
kq AS (SELECT qid, route, CASE route WHEN 'broad' THEN least(n, 60) ELSE least(n, 16) END AS k
       FROM asked JOIN st ON asked.session_id = st.session_id),
qt AS (SELECT DISTINCT qid, session_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS term FROM asked),
tf AS (SELECT session_id, chunk_id, source, term, count(*) AS tf, max(dl) AS dl
       FROM (SELECT session_id, chunk_id, source, len(toks) AS dl, unnest(toks) AS term FROM ct) GROUP BY ALL),
df AS (SELECT session_id, term, count(*) AS df FROM tf GROUP BY ALL),
scores AS (SELECT q.qid, q.session_id, t.chunk_id, t.source,
    round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))), 6) AS score
  FROM qt q JOIN tf t ON q.session_id = t.session_id AND q.term = t.term
  JOIN df d ON d.session_id = t.session_id AND d.term = t.term JOIN st s ON s.session_id = t.session_id GROUP BY ALL),
ranked AS (SELECT s.*, kq.route, kq.k, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, chunk_id) AS r,
    row_number() OVER (PARTITION BY s.qid, source ORDER BY score DESC, chunk_id) AS rs FROM scores s JOIN kq ON s.qid = kq.qid),
hits AS (SELECT qid, session_id, route, 0 AS stage, r AS rank, chunk_id, source, score FROM ranked WHERE r <= k
  UNION ALL SELECT qid, session_id, route, 1, row_number() OVER (PARTITION BY qid ORDER BY source, score DESC, chunk_id),
    chunk_id, source, score FROM ranked p WHERE rs <= 2 AND NOT EXISTS (
    SELECT 1 FROM ranked h WHERE h.r <= h.k AND h.qid = p.qid AND h.source = p.source))""")


@query("retrieve_in_session", _SESSION_SQL + "SELECT * FROM hits")
def retrieve_in_session(spark, d):
    return R.retrieve_in_session(FX.session_questions(spark, d), FX.corpus_chunks(spark, d), base_k=STD_BASE_K)


@query("pack_in_session", _SESSION_SQL[:-1] + """,
manifest AS (SELECT session_id, CAST(count(*) AS VARCHAR) || ' file(s): ' || string_agg(n, ', ' ORDER BY n) AS name
  FROM (SELECT DISTINCT session_id, regexp_replace(source, '_[0-9a-f]{6}(\\.[^.]+)$', '\\1') AS n FROM chunks) GROUP BY session_id)
SELECT h.qid, h.session_id, any_value(m.name) || chr(10) || chr(10) || string_agg('[Source: ' || h.source || ']' || chr(10)
    || c.text, chr(10) || chr(10) ORDER BY h.stage, h.rank) AS context
FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN manifest m ON m.session_id = h.session_id
GROUP BY h.qid, h.session_id""")
def pack_in_session(spark, d):
    """A10 and A11 with the session as the unit: its files, its chunks."""
    ch = FX.corpus_chunks(spark, d)
    return R.pack_context(retrieve_in_session(spark, d), ch, C.file_manifest(ch), by="session_id")


@query("strip_source_tags", _PACK_SQL + r"""
SELECT qid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(context,
         '\s*\[Source:\s*([^\]]+?)\s*\]\s*', ' \1 ', 'g'), '[ \t]{2,}', ' ', 'g'),
         ' +([.,;:)\n])', '\1', 'g'), '^\s+|\s+$', '', 'g') AS answer
FROM packed""")
def strip_source_tags(spark, d):
    return _packed(spark, d).select("qid", R.strip_source_tags(F.col("context")).alias("answer"))


@query("rerank_top_n", W(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_BENCH_Q, FX.bm25_sql("bq"),
                         FX.bm25_sql("bq", name="stemmed", stem=True)) + f"""
SELECT qid, rank, chunk_id, score FROM (
  SELECT c.qid, c.chunk_id, coalesce(s.score, 0) AS score,
         row_number() OVER (PARTITION BY c.qid ORDER BY coalesce(s.score, 0) DESC, c.chunk_id) AS rank
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r
                       FROM stemmed) WHERE r <= {RERANK_POOL}) c
  LEFT JOIN scores s ON s.qid = c.qid AND s.chunk_id = c.chunk_id)
WHERE rank <= {RERANK_N}""")
def rerank_top_n(spark, d):
    """Candidates from a stemmed first stage, re-scored by exact-term
    BM25 (the pluggable scorer), keep 6."""
    qs = FX.bench_questions(spark, d)
    pool = R.bm25_top(qs, FX.term_index(spark, d, True), RERANK_POOL).select("qid", "chunk_id")
    exact = R.bm25_pairs(qs, FX.term_index(spark, d), pool)
    rescored = pool.join(exact, ["qid", "chunk_id"], "left") \
                   .withColumn("score", F.coalesce("score", F.lit(0.0)))
    return R.top_k(rescored, RERANK_N, ["qid"], [F.col("score").desc(), F.col("chunk_id")]) \
            .select("qid", "rank", "chunk_id", "score")


@query("retrieve_two_pass", W(FX.SQL_CORPUS, FX.SQL_CHUNKS, FX.SQL_BENCH_Q, FX.bm25_sql("bq"),
                              FX.bm25_sql("bq", name="stemmed", stem=True)) + f"""
, p1 AS (SELECT qid, 1 AS pass_no, chunk_id, score FROM scores WHERE score >= {TWO_PASS_MIN_SCORE}),
miss AS (SELECT qid FROM bq WHERE qid NOT IN (SELECT qid FROM p1)),
p2 AS (SELECT qid, 2 AS pass_no, chunk_id, score FROM stemmed
       WHERE score >= {TWO_PASS_MIN_SCORE} AND qid IN (SELECT qid FROM miss)),
hits AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
                       FROM hits) WHERE rank <= {TWO_PASS_K})
SELECT qid, pass_no, rank, chunk_id, score, CAST(NULL AS VARCHAR) AS note FROM top
UNION ALL
SELECT qid, 2 AS pass_no, 0 AS rank, NULL AS chunk_id, NULL AS score,
       'I couldn''t find relevant information in the documents to answer your question.' AS note
FROM bq WHERE qid NOT IN (SELECT qid FROM hits)""".replace("\n, p1", ",\np1", 1))
def retrieve_two_pass(spark, d):
    from quarry.operators.answer import retrieve_two_pass as two_pass
    return two_pass(FX.bench_questions(spark, d), FX.term_index(spark, d), TWO_PASS_MIN_SCORE,
                    TWO_PASS_K, FX.term_index(spark, d, True))


@query("build_term_index", W(FX.SQL_CORPUS, FX.SQL_CHUNKS) + r"""
SELECT term, count(DISTINCT chunk_id) AS df FROM (
  SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM chunks)
GROUP BY term""")
def build_term_index(spark, d):
    """J9 ingest side: every chunk's counted terms in one pass over its text,
    without a shuffle, and the document frequencies from them. The bucketed
    postings of ``bm25_topk_stored`` are written from the same rows."""
    terms = forward_rows(FX.chunks(spark, d)).select(F.inline("terms"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
