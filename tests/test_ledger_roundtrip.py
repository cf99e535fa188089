"""Ledger round trip: orders -> raw To/By sheets -> tidy rows == orders."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators.ledger_job import tidy_rows
from quarry.plans import fixtures as FX


def test_tidy_rows_equal_orders(spark):
    tidy = tidy_rows(FX.cells(spark, SF_SMALL))
    o = FX.table(spark, SF_SMALL, "orders").select(
        F.concat(F.lit("SO-"), F.col("o_orderkey").cast("string")).alias("voucher"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("debit"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("credit"))
    got = tidy.select("date", "debit", "credit", "details")
    assert got.count() == o.count()
    # every order's amount and date come back exactly
    a = sorted((r.date, r.debit or -1.0, r.credit or -1.0) for r in got.collect())
    b = sorted((r.date, r.debit or -1.0, r.credit or -1.0) for r in o.collect())
    assert a == b


def test_lsh_recall_against_exact(spark):
    from quarry.operators.lsh import knn_lsh
    from quarry.operators.retrieve import knn
    q, v = FX.vector_questions(spark, SF_SMALL), FX.vectors(spark, SF_SMALL)
    exact = {(r.qid, r.chunk_id) for r in knn(q, v, 10).collect()}
    approx = {(r.qid, r.chunk_id) for r in knn_lsh(q, v, 10).collect()}
    assert len(approx & exact) / len(exact) >= 0.9


def test_language_vote_agrees_with_labels(spark):
    from quarry.operators.analyze import extract_metadata
    docs = FX.table(spark, SF_SMALL, "documents")
    m = extract_metadata(docs.select("doc_id", "text", "lang"))
    agree = m.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert agree >= 0.9
