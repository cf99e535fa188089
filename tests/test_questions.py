"""Searches of a table in itself ask every row of it, in code and in SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from test_oracle import _rows

IDS = [i for i in range(1, 64) if i % 20]  # none is divisible by 20


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("vectors"))
    x = np.random.default_rng(5).normal(size=(len(IDS), 8)).astype(np.float32)
    rows = [(i, v.tolist(), i % 4) for i, v in zip(IDS, x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet/*.parquet')")
    return d, con


@pytest.mark.parametrize("name", ["knn_exact", "knn_indexed", "mmr_rerank", "missing_sources", "source_coverage", "retrieve_with_coverage",
                                  "retrieve_standard", "eval_retrieval"])
def test_every_vector_is_asked(spark, vectors, name):
    d, con = vectors
    got, want = E.queries()[name](spark, d).toPandas(), con.execute(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)
    for rows in (got, want):
        if name == "eval_retrieval":
            assert list(rows["n_queries"]) == [len(IDS)]
        elif name not in ("missing_sources", "source_coverage"):  # these have rows only for sources that are missing
            assert sorted(set(rows["qid"])) == IDS
        else:
            assert len(rows)


def test_lsh_asks_every_vector(spark, vectors):
    assert {r.qid for r in E.queries()["knn_lsh"](spark, vectors[0]).collect()} == set(IDS)


def test_every_title_is_asked(spark, tmp_path):
    d = str(tmp_path)
    rows = [(i, "u", f"<html><head><title>Title word{i} of all</title></head><body><p>Some text word{i % 7}. More.</p>"
             f'<a href="p{i}">word{i} alt</a><div class="ad">word{i % 5} note</div></body></html>') for i in IDS]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet/*.parquet')")
    got, want = E.queries()["multimodal_search"](spark, d).toPandas(), con.execute(E.oracle_sql()["multimodal_search"]).df()
    assert _rows(got) == _rows(want)
    assert sorted(set(got["qid"])) == IDS
