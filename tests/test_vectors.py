"""The partitioned vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ivf


def _frame(spark, x, name):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({name: np.arange(len(x)), "embedding": list(x)}), f"{name} long, embedding array<double>")


def _true(x, asked, k):
    d = (x * x).sum(1) - 2 * (x[asked] @ x.T)
    return {(int(q), int(i)) for q, row in zip(asked, np.argsort(d, axis=1, kind="stable")[:, :k]) for i in row}


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = np.random.default_rng(1)
    x = np.repeat(rnd.standard_normal((1000, 32)), 100, axis=0) + 0.3 * rnd.standard_normal((100_000, 32))
    df = _frame(spark, x, "chunk_id")
    return x, df, ivf.build_index(df, sample_rows=8000, shard=200)


def test_clustered_vectors_are_found_in_few_lists(spark, clustered):
    x, df, index = clustered
    assert index.structured and index.lists.where("shards > 1").count() > 0 and index.codes.count() == len(x)
    asked = np.arange(0, len(x), 500)
    q = df.where("chunk_id % 500 = 0").withColumnRenamed("chunk_id", "qid")
    sizes = index.codes.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    looked = ivf.probed(q, index).join(sizes, "list").agg(F.sum("n")).first()[0]
    assert looked <= 0.05 * len(asked) * len(x)
    got = ivf.knn(q, index, 10)
    want = _true(x, asked, 10)
    rows = {(r.qid, r.chunk_id): r.dist for r in got.collect()}
    assert len(rows) == 10 * len(asked) and len(want & set(rows)) >= 0.9 * len(want)
    assert all(abs(np.sqrt(((x[a] - x[b]) ** 2).sum()) - d) < 1e-5 for (a, b), d in rows.items())


def test_no_exchange_of_vectors(clustered):
    """The stored vectors are read in their buckets; only candidates move."""
    _, df, index = clustered
    q = df.where("chunk_id % 500 = 0").withColumnRenamed("chunk_id", "qid")
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cand = ivf.candidates(q, index, 50).withColumnRenamed("item", "chunk_id")
        plan = cand.join(index.vectors, "chunk_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "Scan parquet" in line and "Bucketed: true" in line)
    sort = max(k for k in range(scan) if "Sort [chunk_id" in lines[k])
    assert "SortMergeJoin" in plan and not any("Exchange" in line for line in lines[sort:scan])


def test_blocks_of_questions_change_nothing(clustered):
    _, df, index = clustered
    q = df.where("chunk_id < 40").withColumnRenamed("chunk_id", "qid")
    one, many = (sorted(map(tuple, ivf.candidates(q, index, 30, block=b).collect())) for b in (512, 3))
    assert one == many


def test_vectors_without_structure_are_searched_exactly(spark):
    x = np.random.default_rng(2).standard_normal((1500, 48))
    df = _frame(spark, x, "chunk_id")
    index = ivf.build_index(df)
    assert not index.structured and index.partition.share > 0.25
    q = df.where("chunk_id < 60").withColumnRenamed("chunk_id", "qid")
    assert {(r.qid, r.chunk_id) for r in ivf.knn(q, index, 10).collect()} == _true(x, np.arange(60), 10)


def test_repeated_vectors_nulls_and_empty_tables(spark):
    """One vector is a third of all rows; ties go to the smaller id."""
    rnd = np.random.default_rng(3)
    x = np.repeat(rnd.standard_normal((60, 8)), 25, axis=0) + 0.01 * rnd.standard_normal((1500, 8))
    x[500:1000] = x[500]
    df = _frame(spark, x, "chunk_id").unionByName(spark.createDataFrame([(9000, None), (9001, [])], "chunk_id long, embedding array<double>"))
    index = ivf.build_index(df, shard=100)
    assert index.structured
    q = df.where("chunk_id in (3, 500, 9000, 9001)").withColumnRenamed("chunk_id", "qid")
    got = ivf.knn(q, index, 20).collect()
    assert sorted(r.chunk_id for r in got if r.qid == 500) == list(range(500, 520)) and {r.qid for r in got} == {3, 500}
    assert ivf.knn(q.limit(0), index, 5).count() == 0
    none = ivf.build_index(df.limit(0))
    assert not none.structured and ivf.knn(q, none, 5).count() == 0
    with pytest.raises(Exception, match="one length"):
        ivf.build_index(df.unionByName(spark.createDataFrame([(9002, [1.0])], df.schema)), sample_rows=600).codes.count()


def test_sparse_vectors_of_odd_texts(spark):
    from quarry.operators import sparse

    rows = [("a", "red fox red"), ("b", "red hen"), ("c", None), ("d", ""), ("e", "red"), ("f", "fox fox fox")]
    ch = spark.createDataFrame(rows, "chunk_id string, text string")
    idf = sparse.fit_idf(ch)
    v = {r.chunk_id: (list(r.indices), list(r.weights)) for r in sparse.embed(ch, idf).collect()}
    assert set(v) == set("abcdef") and v["c"] == v["d"] == ([], [])
    assert all(i == sorted(set(i)) and (not w or abs(sum(x * x for x in w) - 1) < 1e-9) for i, w in v.values())
    assert set(v["f"][0]) < set(v["a"][0])
    # fewer indices than terms: counts of terms that share one are added
    tight = sparse.embed(ch, sparse.fit_idf(ch, dims=1), dims=1).collect()
    assert {tuple(r.indices) for r in tight} == {(0,), ()}
    q = sparse.embed(spark.createDataFrame([(1, "fox"), (2, "unknown"), (3, None)], "qid int, question string"), idf, "question", "qid")
    got = [(r.qid, r.chunk_id, r["rank"], r.dist) for r in sparse.nearest(q, sparse.embed(ch, idf), 2).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(1, "f", 1), (1, "a", 2)] and got[0][3] == 0.0
    one = sparse.nearest(q, sparse.embed(ch, idf), 2, shards=1).collect()
    assert {(r.qid, r.chunk_id, r.dist) for r in one} == {(a, b, d) for a, b, _, d in got}
    empty = sparse.embed(ch.limit(0), sparse.fit_idf(ch.limit(0)))
    assert empty.count() == 0 and sparse.nearest(q, empty, 2).count() == 0


def test_sparse_vectors_are_made_in_the_row_and_searched_in_cells(spark):
    from quarry.operators import sparse

    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i:03d}", " ".join(words[(i * j * j + j) % 30] for j in range(i % 17)) + " common") for i in range(200)]
    ch = sparse.count_terms(spark.createDataFrame(rows, "chunk_id string, text string"))
    idf = sparse.fit_idf(ch)
    v = sparse.embed(ch, idf)
    assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()
    q = sparse.embed(spark.createDataFrame([(i, f"w{i} w{i + 3} common") for i in range(8)], "qid int, question string"), idf, "question", "qid")
    dense = {r.chunk_id: dict(zip(r.indices, r.weights)) for r in v.collect()}
    want = set()
    for r in q.collect():
        a = dict(zip(r.indices, r.weights))
        cos = {c: sum(w * b.get(i, 0.0) for i, w in a.items()) for c, b in dense.items()}
        near = sorted((round(max(0.0, round(2 - 2 * x, 9)) ** 0.5, 6), c) for c, x in cos.items() if x > 0)
        want |= {(r.qid, c, n + 1, d) for n, (d, c) in enumerate(near[:4])}
    found = sparse.nearest(q, v, 4, shards=3)
    got = {(r.qid, r.chunk_id, r["rank"], round(r.dist, 6)) for r in found.collect()}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pairs of questions and items are not made as rows


def test_sparse_vectors_of_rows_that_share_an_id(spark):
    from quarry.operators import sparse

    rows = [("a", "x", "red fox"), ("a", "y", "red hen"), ("b", "x", "red"), (None, "x", "fox"), (None, "y", "hen")]
    ch = sparse.count_terms(spark.createDataFrame(rows, "chunk_id string, source string, text string"))
    idf = sparse.fit_idf(ch)
    by_id = sorted((r.chunk_id or "", len(r.indices)) for r in sparse.embed(ch, idf).collect())
    assert by_id == [("", 2), ("a", 4), ("b", 1)]
    kept = sorted((r.chunk_id or "", r.source, len(r.indices)) for r in sparse.embed(ch, idf, keep=("source",)).collect())
    assert kept == [("", "x", 2), ("", "y", 2), ("a", "x", 4), ("a", "y", 4), ("b", "x", 1)]
