"""Answer assembly: two-pass retrieval, prompts, extractive answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import retrieve as R

# Fixed value: the reference's reply when nothing was retrieved.
NO_HITS = "I couldn't find relevant information in the documents to answer your question."


def retrieve_two_pass(questions: DataFrame, index, min_score: float, k: int, stem_index) -> DataFrame:
    """Pass 1 with the question; questions without any hit at or above
    ``min_score`` are rewritten (default rewrite: the common endings of words
    are taken off, ``retrieve.STEM_RE``) and retrieved once more; still
    nothing -> the fixed apology row. Bounded: at most one rewrite, no loop.
    ``index`` / ``stem_index`` are the exact-term and stemmed ``TermIndex``."""
    s1 = (R.bm25_top(questions, index, k).drop("rank").where(F.col("score") >= min_score)
          .withColumn("pass_no", F.lit(1)))
    miss = questions.join(s1.select("qid").distinct(), "qid", "left_anti")
    s2 = (R.bm25_top(miss, stem_index, k).drop("rank").where(F.col("score") >= min_score)
          .withColumn("pass_no", F.lit(2)))
    hits = s1.unionByName(s2)
    top = R.top_k(hits, k, ["qid"], [F.col("score").desc(), F.col("chunk_id")]) \
        .select("qid", "pass_no", "rank", "chunk_id", "score", F.lit(None).cast("string").alias("note"))
    none = (questions.join(hits.select("qid").distinct(), "qid", "left_anti")
            .select("qid", F.lit(2).alias("pass_no"), F.lit(0).alias("rank"),
                    F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("double").alias("score"),
                    F.lit(NO_HITS).alias("note")))
    return top.unionByName(none)


def humanize(cols: list[str], table_name: str):
    """``According to <file>, k: v, k: v.`` with thousands separators;
    blank values are skipped; when every value is blank the raw pairs show."""
    from quarry.functions import exprs as X
    parts = F.filter(F.array(*[F.when(~X.is_blank(F.col(c)), F.concat(F.lit(c + ": "), X.fmt_num(F.col(c))))
                               for c in cols]), lambda p: p.isNotNull())
    raw = F.array_join(F.array(*[F.concat(F.lit(c + ": "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
                                 for c in cols]), ", ")
    body = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(raw)
    return F.concat(F.lit(f"According to {table_name}, "), body, F.lit("."))
