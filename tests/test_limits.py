"""Inputs that once hit a size limit, a prefix or a wrong tie rule."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import exprs as X
from quarry.operators import corpus, ledger, lsh, multimodal, retrieve, tables
from quarry.operators.infer import validate_json


def test_chunk_ids_of_long_documents_differ(spark):
    rows = spark.range(3).select(corpus.chunk_id(F.lit(7), F.element_at(F.array(F.lit(10_000), F.lit(100_000), F.lit(1_000_000)),
                                                                       (F.col("id") + 1).cast("int"))).alias("c"))
    assert rows.distinct().count() == 3


def test_element_ids_of_long_pages_differ(spark):
    el = spark.createDataFrame([(1, o, "text", "x") for o in (1_000, 10_000, 100_000)], "page_id long, ord int, modality string, text string")
    assert multimodal.payloads(el).select("doc_id").distinct().count() == 3


def test_common_terms_still_find_chunks(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"invoice total {i}") for i in range(3)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "invoice total")], "qid long, question string")
    assert retrieve.bm25(q, chunks).count() == 3
    assert retrieve.bm25_indexed(q, retrieve.build_term_index(chunks)).count() == 3


def test_stems_join_forms_of_a_word_only(spark):
    words = "invoice invoices invoiced invoicing interest internal international process processes"
    got = spark.range(1).select(retrieve.term_tokens(F.lit(words), True).alias("t")).first().t
    assert len(set(got[:4])) == 1 and len({*got[4:7]}) == 3


def test_reuploaded_file_keeps_its_fingerprint(spark):
    d = spark.createDataFrame([("r_0a1b2c.pdf", "t"), ("r_ffffff.pdf", "t")], "source string, text string")
    assert corpus.fingerprint(d).select("fp").distinct().count() == 1


def test_head_tail_of_a_short_table(spark):
    got = tables.head_tail(spark.range(5).select(F.col("id").alias("k")), ["k"]).collect()
    assert sorted(r.k for r in got) == [0, 1, 2, 3, 4]


def test_extreme_row_of_text_ids_and_values(spark):
    d = spark.createDataFrame([("g", "b", "x2"), ("g", "b", "x1"), ("g", "a", "x3"), ("g", None, "x0")], "g string, v string, id string")
    got = {r.kind: (r.id, r.v) for r in tables.extreme_row(d, ["g"], "v", ["id"]).collect()}
    assert got == {"highest": ("x1", "b"), "lowest": ("x3", "a")}


def test_images_are_capped_after_other_links_are_left_out(spark):
    a = spark.createDataFrame([(1, f"/p{i}.html") for i in range(9)] + [(1, f"/z{i}.PNG") for i in range(4)], "page_id long, path string")
    assert sorted(r.path for r in multimodal.cap_images(a, 3).collect()) == ["/z0.PNG", "/z1.PNG", "/z2.PNG"]


def test_column_names_stay_unique(spark):
    cells = spark.createDataFrame([("f", "s", 0, ["a", "a_1", "a", None, "a"])], "file string, sheet string, row_idx long, cells array<string>")
    header = spark.createDataFrame([("f", "s", 0)], "file string, sheet string, header_idx long")
    names = [r.name for r in ledger.column_names(cells, header).orderBy("j").collect()]
    assert names == ["a", "a_1", "a_2", "col3", "a_3"]


@pytest.mark.parametrize(("text", "want"), [
    ("05/03/2024", "2024-05-03"), ("12/25/2024", "2024-12-25"), ("25/12/2024", "2024-12-25"), ("2024-01-05 00:00:00", "2024-01-05"),
    ("5 Jan 2024", "2024-01-05"), ("5-Jan-2024", "2024-01-05"), ("2024/1/5", "2024-01-05"), ("Total", None), ("12.5", None),
    ("January 5, 2024", "2024-01-05"), ("Jan 5, 2024", "2024-01-05"), ("01/02/24", "2024-01-02"), ("5-Jan-24", "2024-01-05"),
    ("2024-01-05T10:00:00", "2024-01-05"), ("12/25/2024 10:00:00", "2024-12-25"), ("5 January 2024", "2024-01-05"),
    ("20240105", "2024-01-05"), ("05.01.2024", "2024-05-01"), ("2024-01-05 10:00:00.123Z", "2024-01-05"), ("3rd Sept. 1999", "1999-09-03"),
    ("Dec 31 69", "1969-12-31"), ("1/2/2024 3:04 PM", "2024-01-02"), ("2024-Feb-29", "2024-02-29"), ("2023-02-29", None), ("13/13/2024", None),
    ("Janus 5, 2024", None), ("", None), (None, None), ("10:00:00", None), ("123456789", None), ("5 May", None)])
def test_dates(spark, text, want):
    got = spark.range(1).select(F.date_format(X.coerce_date(F.lit(text)), "yyyy-MM-dd").alias("d")).first().d
    assert got == want


def test_records_need_every_field_and_type(spark):
    rows = ['{"Title":"x"}', '{"Title":"x","Pages":"many"}', '{"Title":"x","Pages":3}', "no json", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: r.valid for r in validate_json(d, "raw", "Title string, Pages int").collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False}


def test_lsh_prunes_clustered_vectors_and_splits_no_bucket(spark):
    import numpy as np
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((100, 32))
    x = np.repeat(centres, 10, axis=0) + 0.1 * rnd.standard_normal((1000, 32))
    x[500:800] = x[500]  # one bucket holds a third of all rows
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1001, [])], "chunk_id long, embedding array<double>")
    few = v.where("chunk_id between 0 and 499").withColumnRenamed("chunk_id", "qid")
    pairs = lsh.candidates(few, v, 12, 8, 7, "qid", "chunk_id", "embedding")
    assert pairs.count() <= 0.05 * 500 * 1000
    dist = ((x[:500, None] - x[None]) ** 2).sum(2)
    want = {(q, int(i)) for q in range(500) for i in np.argsort(dist[q], kind="stable")[:10]}
    got = {(r.qid, r.chunk_id) for r in lsh.knn_lsh(few, v, 10, bits=12, n_tables=8).collect()}
    assert len(want & got) >= 0.9 * len(want)
    hot = lsh.knn_lsh(v.where("chunk_id = 500").withColumnRenamed("chunk_id", "qid"), v, 300, bits=12, n_tables=8)
    assert sorted(r.chunk_id for r in hot.collect()) == list(range(500, 800))


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_median_by_counts(spark, bits):
    import statistics
    groups = {"a": [1.5], "b": [2.0, 3.0], "c": [-1e308, 1e308, 1e300], "d": [5e-324, 0.0], "e": [7.0] * 9 + [8.0] * 9,
              None: [float(i * i % 101) / 7 for i in range(200)], "f": [None], "g": [None, 4.0, float("nan")]}
    d = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    got = {r.k: r.median for r in tables.exact_median(d, ["k"], "v", bits).collect()}
    want = {k: [v for v in vs if v is not None and v == v] for k, vs in groups.items()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in want.items() if v})
    assert tables.exact_median(d.limit(0), [], "v", bits).count() == 0
    for k, v in want.items():
        mine = d.where(F.col("k").eqNullSafe(k))
        assert tables.column_median(mine, "v", bits) == (pytest.approx(statistics.median(v)) if v else None)
    assert [r.value for r in tables.agg_labeled(d.where("k = 'f'"), [("m", "median", "v"), ("n", "count", "v")]).orderBy("label").collect()] == [None, 0.0]


def test_table_names_meet_without_a_nested_loop(spark):
    names = ["Sales 2024.xlsx::North", "sales", "b", "Ünï::x", "a very long name of a sheet in a file", ""]
    requests = ["SALES", "sales", "north", "the very long name of a sheet", "a very long name of a sheet in a file, please", "zzz", "ÜNÏ", None, "B"]
    c = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int")
    r = spark.createDataFrame([(q,) for q in requests], "request string")

    def resolve(q):
        if q is None:
            return None
        hits = [(n != q, i, n) for i, n in enumerate(names) if n.lower() in q.lower() or q.lower() in n.lower()]
        return min(hits)[2] if hits else None
    out = tables.resolve_table_name(r, c)
    assert {x.request: x.resolved for x in out.collect()} == {q: resolve(q) for q in requests}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_all_text_of_a_page_is_kept(spark):
    import re
    page = ("<html><head><TITLE>T &amp; t</TITLE><style>no{}</style></head><body>start<H1 class='x'>Head</H1>between<div>in div"
            "<ul><li>outer<ul><li>inner</li></ul>tail</li></ul><blockquote>quoted</blockquote></div><p>one<br>two<p>open"
            "<table><tr><td>a<p>b</p></td><td>c</td></tr></table>after<!-- no --><script>var t='</p>';</script> end\x01</body></html>")
    d = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "only text"), (5, "<table><tr><td>unclosed")], "page_id long, html string")
    rows = multimodal.elements(d).orderBy("page_id", "ord").collect()
    got = [(r.tag, r.text) for r in rows if r.page_id == 1]
    assert got == [("title", "T & t"), ("body", "start"), ("h1", "Head"), ("", "between"), ("div", "in div"), ("li", "outer"),
                   ("li", "inner"), ("", "tail"), ("blockquote", "quoted"), ("p", "one two"), ("p", "open"), ("table", "a b c"),
                   ("", "after end")]
    assert {r.page_id: r.text for r in rows if r.page_id > 1} == {4: "only text", 5: "unclosed"}
    from conftest import SF_SMALL
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    kept = {r.page_id: "".join(t for _o, t in sorted(map(tuple, r.e))) for r in multimodal.elements(pages).groupBy("page_id").agg(
        F.collect_list(F.struct("ord", "text")).alias("e")).collect()}
    for r in pages.collect():
        plain = re.sub(r"<[^>]+>", "", re.sub(multimodal.DROP_RE, "", r.html))
        for k, v in multimodal.ENTITIES:
            plain = plain.replace(k, v)
        assert re.sub(r"\s+", "", kept[r.page_id]) == re.sub(r"\s+", "", plain)


def test_nearest_neighbours_stay_in_their_scope(spark):
    """Several blocks of questions, a scope that is null, a row without a vector."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3], i % 2, [float(x) for x in rng.normal(size=4)]) for i in range(90)]
    schema = "chunk_id long, session_id string, source int, embedding array<double>"
    items = spark.createDataFrame(rows + [(500, "a", 0, None)], schema)
    got = retrieve.knn(items.withColumnRenamed("chunk_id", "qid"), items, 3, group="source", scope="session_id", block=20, item_blocks=3,
                       sub_batch=7).collect()
    want = set()
    for q, s, _, v in rows:
        for g in (0, 1):
            d = sorted((round(float(np.linalg.norm(np.subtract(v, w))), 6), i) for i, t, h, w in rows if t == s and h == g)
            want |= {(q, g, i, x) for x, i in d[:3]}
    assert {(r.qid, r.source, r.chunk_id, r.dist) for r in got} == want


def test_pools_cut_by_a_batch_are_reranked_whole(spark):
    items = spark.range(40).select(F.col("id").alias("chunk_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    asked = items.withColumnRenamed("chunk_id", "qid")
    pool = retrieve.knn(asked, items, 12)
    whole = {tuple(r) for r in retrieve.mmr(pool, asked, items, 5).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {tuple(r) for r in retrieve.mmr(pool, asked, items, 5).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(whole) == 200
