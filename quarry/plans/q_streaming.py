"""Registered streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import fixtures as FX
from quarry.plans.q_sources import staged_files
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.streaming import index_segments as segments
from quarry.streaming.history_stream import fold
from quarry.streaming.history_stream import stream_history as run_history
from quarry.streaming.index_stream import stream_index as run_index


@query("stream_index")
def stream_index(spark, d):
    """Index the staged document files as a stream, then replay the same
    stream from a fresh checkpoint: the replay adds no rows. Returns the
    corpus size per session after both runs."""
    src = staged_files(spark, d)["text"]
    corpus = scratch_path(spark, "stream-corpus")
    run_index(spark, src, corpus, scratch_path(spark, "stream-ckpt"))
    run_index(spark, src, corpus, scratch_path(spark, "stream-ckpt"))
    return spark.read.parquet(corpus).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("fp").alias("n_fp"))


_DOC_SCHEMA = "doc_id long, source string, session_id string, text string"


@query("stream_segments", FX.with_(FX.SQL_CORPUS, FX.SQL_CHUNKS, """one AS (
  SELECT session_id, source || '::' || sha256(text) AS fp, any_value(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS toks
  FROM chunks GROUP BY ALL)""", FX.SQL_ROUTED_Q, FX.SQL_SESSION_Q, """qt AS (
  SELECT DISTINCT qid, session_id, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+')) AS term FROM sq)""", """st AS (
  SELECT session_id, count(*) AS n, avg(len(toks)) AS avgdl FROM one GROUP BY session_id)""", """tf AS (
  SELECT session_id, fp, term, count(*) AS tf, max(dl) AS dl FROM (
    SELECT session_id, fp, len(toks) AS dl, unnest(toks) AS term FROM one) GROUP BY ALL)""", """df AS (
  SELECT session_id, term, count(*) AS df FROM tf GROUP BY ALL)""", """scores AS (
  SELECT q.qid, q.session_id, t.fp, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2
      / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))), 6) AS score
  FROM qt q JOIN tf t ON q.session_id = t.session_id AND q.term = t.term
  JOIN df d ON d.session_id = t.session_id AND d.term = t.term JOIN st s ON s.session_id = t.session_id GROUP BY ALL)""") + """
SELECT qid, session_id, rank, fp, score, 1 AS n_segments FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, session_id ORDER BY score DESC, fp) AS rank FROM scores) WHERE rank <= 5""")
def stream_segments(spark, d):
    """The documents arrive as a stream of files in several micro-batches,
    each appends a segment; then the whole stream is replayed (which adds no
    chunk) and the segments are merged. Returns BM25 top 5 of each question
    in its session over what is live, which equals an index built
    from the documents at once."""
    src, root = scratch_path(spark, "segment-src"), scratch_path(spark, "segments")
    FX.corpus(spark, d).repartition(4, "doc_id").write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(_DOC_SCHEMA).option("maxFilesPerTrigger", 2).parquet(src)
        segments.stream_segments(stream.select("doc_id", "source", "session_id", "text"), root, scratch_path(spark, "segment-ckpt"))
    segments.compact(spark, root)
    best = segments.segment_top(spark, root, FX.session_questions(spark, d), 5)
    return best.select("qid", "session_id", "rank", "fp", "score", F.lit(len(segments.live_segments(spark, root))).alias("n_segments"))


_CONV_SCHEMA = "conv_id long, turn long, role string, text string"


@query("stream_history", """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
  FROM conversations) WHERE r <= 12""")
def stream_history(spark, d):
    """Conversation turns arrive as a stream of files, some of a
    conversation's turns in each; keyed state holds each conversation's last 12
    turns. The stream runs in two parts (the second goes on from the first's
    checkpoint), with a snapshot between them."""
    src = scratch_path(spark, "conv-src")
    conv = FX.table(spark, d, "conversations")
    later = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2)) == 0
    root, ckpt = scratch_path(spark, "conv-buffer"), scratch_path(spark, "conv-ckpt")
    conv.where(~later).coalesce(2).write.parquet(src)
    run_history(spark, src, _CONV_SCHEMA, root, ckpt)
    fold(spark, root, ckpt)
    conv.where(later).coalesce(2).write.mode("append").parquet(src)
    return run_history(spark, src, _CONV_SCHEMA, root, ckpt).select("conv_id", "turn", "role", "text")
