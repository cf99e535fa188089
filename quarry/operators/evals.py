"""Retrieval and answer evaluation, plus extractive answers and prompts.

Every metric is an aggregate over per-question rows (one shuffle by
question); candidate sentences come only from the retrieved chunks, so the
work is bounded by k chunks per question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import exprs as X

PASS_MARK = 0.5


def extractive_answer(questions: DataFrame, hits: DataFrame, chunks: DataFrame, split_re: str,
                      n: int = 3) -> DataFrame:
    """R13 default generator: split the hit chunks into sentences, score each
    by distinct question terms it contains, keep the best ``n`` (ties: hit
    rank, position) and join them in context order."""
    sent = (hits.join(chunks.select("chunk_id", "text"), "chunk_id")
            .select("qid", "rank", F.posexplode(F.split("text", split_re)).alias("pos", "s"))
            .withColumn("s", X.strip(F.col("s"))).where(F.col("s") != ""))
    qt = questions.select("qid", F.array_distinct(X.tokens(F.col("question"))).alias("qt"))
    scored = sent.join(qt, "qid").withColumn(
        "score", F.size(F.array_intersect(F.array_distinct(X.tokens(F.col("s"))), F.col("qt"))))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank", "pos")
    best = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return best.groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "pos", "s"))), lambda x: x["s"]), "\n").alias("answer"))


def answer_scores(questions: DataFrame, answers: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """relevancy = |answer terms & question terms| / |question terms|;
    faithfulness = |answer terms & context terms| / |answer terms|; plus
    answer numbers with no context number within 0.01 (F3 per number)."""
    ctx = (hits.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("qid")
           .agg(F.array_distinct(F.flatten(F.collect_list(X.tokens(F.col("text"))))).alias("ct"),
                F.flatten(F.collect_list(X.extract_numbers(F.col("text")))).alias("cn")))
    qt = questions.select("qid", F.array_distinct(X.tokens(F.col("question"))).alias("qt"))
    m = answers.join(qt, "qid").join(ctx, "qid").select(
        "qid", "qt", "ct", "cn", F.array_distinct(X.tokens(F.col("answer"))).alias("at"),
        X.extract_numbers(F.col("answer")).alias("an"))

    def ratio(a, b):
        return F.round(F.when(F.size(b) == 0, F.lit(0.0))
                       .otherwise(F.size(F.array_intersect(a, b)) / F.size(b)), 6)
    unsupported = F.size(F.filter("an", lambda a: ~F.exists("cn", lambda c: F.abs(a - c) < 0.01)))
    return m.select("qid", ratio(F.col("at"), F.col("qt")).alias("relevancy"),
                    F.round(F.when(F.size("at") == 0, F.lit(0.0)).otherwise(
                        F.size(F.array_intersect("at", "ct")) / F.size("at")), 6).alias("faithfulness"),
                    F.size("an").alias("n_numbers"), unsupported.alias("n_unsupported"))


def pass_rate(scores: DataFrame, mark: float = PASS_MARK) -> DataFrame:
    ok = (F.col("relevancy") >= mark) & (F.col("faithfulness") >= mark)
    return scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"))


def retrieval_metrics(rel: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """precision@k, recall@k, MRR from ranked hits flagged ``relevant``
    and the number of relevant items per label (``sizes``)."""
    per_q = rel.groupBy("qid", "qlabel").agg(
        F.count_if("relevant").alias("rel"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rel"))
    per_q = per_q.join(sizes, "qlabel")
    return per_q.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.col("rel") / k), 6).alias("precision_at_k"),
        F.round(F.avg(F.when(F.col("n_rel") > 0, F.col("rel") / F.col("n_rel")).otherwise(0.0)), 6)
        .alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_rel"), F.lit(0.0))), 6).alias("mrr"))


def assemble_prompts(packed: DataFrame, questions: DataFrame, manifest: DataFrame, by: str) -> DataFrame:
    """Our own prompt wording around the manifest and packed context."""
    j = packed.join(questions.select("qid", "question"), "qid").join(manifest.select(by, "name"), by)
    return j.select("qid", F.concat(
        F.lit("Answer the question from the context below. Name files naturally; use only these files: "),
        F.col("name"), F.lit("\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"),
        F.lit("\nAnswer:")).alias("prompt"))
