"""The stored BM25 index and the segments of the indexing stream."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import postings as P
from quarry.operators import retrieve as R
from quarry.session import scratch_path
from quarry.streaming import index_segments as S

rnd = random.Random(3)
WORDS = [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(min(rnd.choices(WORDS, k=3)) for _ in range(n))  # some words are in nearly every chunk


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{i:03d}", prose(rnd.randint(1, 40))) for i in range(300)]
    rows += [("t1", "tie tie"), ("t2", "tie tie"), ("t3", "tie tie"), ("e1", ""), ("e2", "...")]
    return spark.createDataFrame(rows, "chunk_id string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(q, prose(rnd.randint(1, 6))) for q in range(25)] + [(100, "tie"), (101, "nothing here"), (102, ""), (103, prose(60)), (104, "w45 w0 w1 w2")]
    return spark.createDataFrame(rows, "qid int, question string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block,split,stem", [(128, 1 << 16, False), (4, 16, False), (1, 7, True), (3, 1 << 16, False)])
def test_bounds_find_what_scoring_everything_finds(chunks, questions, block, split, stem):
    index = P.build_index(chunks, stem, block=block, split=split, buckets=4)
    want = R.bm25(questions, chunks, stem=stem)
    assert rows(index.scores(questions).select("qid", "chunk_id", "score")) == rows(want.select("qid", "chunk_id", "score"))
    assert (index.terms.where("shards > 1").count() > 0) == (split < 100)
    assert index.blocks.where(F.size("postings") > block).isEmpty()
    for k in (1, 2, 10):
        best = R.top_k(want, k, ["qid"], [F.col("score").desc(), F.col("chunk_id")])
        assert rows(index.top(questions, k).select("qid", "rank", "chunk_id", "score")) == rows(best.select("qid", "rank", "chunk_id", "score"))


def test_common_words_are_not_read(chunks, questions):
    index = P.build_index(chunks, block=4, buckets=4)
    few = questions.where("qid = 104")
    assert index.candidates(few, 1).count() < index.scores(few).count() / 2


def test_pair_scores_come_from_the_forward_rows(chunks, questions):
    index = P.build_index(chunks, buckets=4)
    want = R.bm25(questions, chunks).where("chunk_id < 'c020'").select("qid", "chunk_id", "score")
    assert rows(index.pair_scores(questions, want).select("qid", "chunk_id", "score")) == rows(want)


def test_postings_are_not_shuffled(spark, chunks, questions):
    index = P.build_index(chunks, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    try:
        plan = index.scores(questions)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(k for k, line in enumerate(plan.split("\n")) if "FileScan" in line and "postings" in line)
    above = plan.split("\n")[:scan]
    depth = len(plan.split("\n")[scan].split("FileScan")[0])
    for line in reversed(above):  # parents of the scan up to the join
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth = indent
            if "Join" in line:
                break
            assert "Exchange" not in line
    assert "Bucketed: true" in plan.split("\n")[scan]


def test_chunks_of_pairs_are_found_without_a_shuffle_of_the_forward_rows(spark, chunks, questions):
    index = P.build_index(chunks, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = R.bm25(questions, chunks).select("qid", "chunk_id")
        plan = index.pair_scores(questions, pairs)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("FileScan" in line and "chunk_id" in line and "Bucketed: true" in line for line in plan)


def test_blocks_are_in_order_of_impact_and_hold_every_posting_once(chunks):
    index = P.build_index(chunks, block=4, split=16, buckets=4)
    blocks = index.blocks.collect()
    held = sorted((b.term, p.chunk_id) for b in blocks for p in b.postings)
    assert held == sorted((r.term, r.chunk_id) for r in index.forward.select("chunk_id", F.inline("terms")).collect())
    lists = {}
    for b in sorted(blocks, key=lambda b: b.block):
        assert b.top_of_block == b.postings[0].impact
        lists.setdefault((b.term, b.shard), []).extend((-p.impact, p.chunk_id) for p in b.postings)
    assert all(v == sorted(v) for v in lists.values()) and len({t for t, _ in lists}) < len(lists)


def test_index_of_nothing(spark, chunks, questions):
    index = P.build_index(chunks.where("false"), buckets=2)
    assert index.top(questions, 3).isEmpty() and index.scores(questions).isEmpty()
    assert P.build_index(chunks, buckets=2).top(questions.where("false"), 3).isEmpty()


def test_counted_terms(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["x"],)], "t array<string>").select(P.counted_terms(F.col("t")).alias("c"))
    assert [[tuple(x) for x in r.c] for r in got.collect()] == [[("a", 1), ("b", 2)], [], [], [("x", 1)]]


# ---- segments

DOCS = "doc_id long, source string, session_id string, text string"


def documents(spark, ids):
    return spark.createDataFrame([(i, f"f{i % 3}.txt", f"s{i % 2}", f"{prose(200)} mark{i}") for i in ids], DOCS)


@pytest.fixture(scope="module")
def folder(spark):
    src = scratch_path(spark, "seg-src")
    for part in range(4):
        documents(spark, range(part * 10, part * 10 + 10)).coalesce(1).write.mode("append").parquet(src)
    return src


def stream(spark, src):
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(src)


def asked(spark):
    return spark.createDataFrame([(1, "s0", "mark4 w0 w1"), (2, "s1", "w2 w3 mark7"), (3, "s0", "mark7")], "qid int, session_id string, question string")


def at_once(spark, src):
    from quarry.operators import corpus as C
    chunks = C.fingerprint(C.chunk_fixed(spark.read.parquet(src)))
    ids = chunks.groupBy("session_id", "fp").agg(F.min("chunk_id").alias("chunk_id")).select("session_id", "chunk_id")
    return rows(R.bm25_in_scope(asked(spark), chunks.join(ids, ["session_id", "chunk_id"])).select("qid", "session_id", "chunk_id", "score"))


def scored(spark, root):
    return rows(S.segment_scores(spark, root, asked(spark)).select("qid", "session_id", "chunk_id", "score"))


def test_segments_equal_an_index_built_at_once(spark, folder):
    root, check = scratch_path(spark, "seg"), scratch_path(spark, "seg-ck")
    S.stream_segments(stream(spark, folder), root, check)
    want = at_once(spark, folder)
    assert len(S.live_segments(spark, root)) == 4 and scored(spark, root) == want
    S.stream_segments(stream(spark, folder), root, check)  # a restart: nothing new
    assert len(S.live_segments(spark, root)) == 4
    S.stream_segments(stream(spark, folder), root, scratch_path(spark, "seg-ck"))  # the same files again
    assert S.read_table(spark, root, "sizes").agg(F.sum("n")).first()[0] == S.read_table(spark, root, "chunks").count()
    assert scored(spark, root) == want
    old = S.live_segments(spark, root)
    merged = S.compact(spark, root)
    assert S.live_segments(spark, root) == [merged] and scored(spark, root) == want and S.compact(spark, root) is None
    assert S.read_table(spark, root, "chunks", old).count() == S.read_table(spark, root, "chunks").count()  # old readers go on


def test_a_batch_that_runs_twice_counts_once(spark, folder):
    root = scratch_path(spark, "seg")
    docs = spark.read.parquet(folder)
    for name, part in (("a", "doc_id < 10"), ("b", "doc_id >= 10"), ("b", "doc_id >= 10"), ("a", "doc_id < 10")):
        S.add_batch(docs.where(part), root, name)
    assert S.live_segments(spark, root) == ["a", "b"] and scored(spark, root) == at_once(spark, folder)


def test_new_documents_after_a_merge(spark, folder):
    root = scratch_path(spark, "seg")
    docs = spark.read.parquet(folder)
    for k, part in enumerate(("doc_id < 10", "doc_id between 10 and 19", "doc_id > 15")):
        S.add_batch(docs.where(part), root, f"b{k}")
        S.compact(spark, root)
    assert scored(spark, root) == at_once(spark, folder)


def test_best_of_segments_without_pairs_of_all(spark, folder):
    root = scratch_path(spark, "seg")
    docs = spark.read.parquet(folder)
    twice = docs.where("doc_id = 4").selectExpr("doc_id", "source", "session_id", "'mark4 w1 again' AS text")  # another text of an id
    S.add_batch(docs.where("doc_id < 20").unionByName(docs.where("doc_id < 3")), root, "a")
    S.add_batch(docs.where("doc_id >= 20").unionByName(twice), root, "b")
    fps = S.read_table(spark, root, "chunks").select("session_id", "chunk_id", "fp")
    every = S.segment_scores(spark, root, asked(spark)).join(fps, ["session_id", "chunk_id"])
    want = R.top_k(every, 3, ["qid", "session_id"], [F.col("score").desc(), F.col("fp")])
    best = S.segment_top(spark, root, asked(spark), 3)
    cols = ["qid", "session_id", "rank", "fp", "score"]
    assert rows(best.select(cols)) == rows(want.select(cols)) and best.count() == 6
    # a chunk is stored once, with its terms: no posting a row
    assert set(S.TABLES) == {"chunks", "terms", "sizes"}


def test_no_segments(spark):
    assert S.segment_scores(spark, scratch_path(spark, "seg"), asked(spark)).isEmpty()
    assert S.segment_top(spark, scratch_path(spark, "seg"), asked(spark), 3).isEmpty()


def test_images_tables_and_texts_are_found_and_capped(spark):
    from quarry.operators import mm_store

    pages = spark.createDataFrame([
        (1, "<p>Plain words. More of them</p><IMG alt='red fox' src='/b.png'><img src=\"/b.png\" alt=\"late\"><img src=\"/c.txt\" alt=\"fox\">"),
        (2, "<table><tr><td>fox prices</td></tr></table><!-- <img src=\"/x.png\"> --><img src=\"/dir/fox.JPG\" alt=\" \">"),
        (3, "".join(f'<img src="/{k:02d}.gif" alt="fox {k}">' for k in range(12))), (4, None), (5, "")], "page_id long, html string")
    store = mm_store.build(pages, buckets=2)
    kept = {r.payload: r.summary for r in store.payloads.where("modality = 'image'").collect()}
    assert kept == {"/b.png": "red fox", "/dir/fox.JPG": "fox"} | {f"/{k:02d}.gif": f"fox {k}" for k in range(8)}
    q = spark.createDataFrame([(7, "fox"), (8, "plain"), (9, None), (10, "nothing there")], "qid int, question string")
    rows = mm_store.search(store, q).collect()
    assert {r.qid for r in rows} == {7, 8}
    assert [r.payload for r in rows if r.modality == "table"] == ["fox prices"]
    found = sorted((r.rank, r.payload, r.context) for r in rows if r.modality == "image")
    assert len(found) == 5 and found[0][1:] == ("/dir/fox.JPG", "fox")
    assert {r.context for r in rows if r.qid == 8} == {"Plain words. More of them"}
    assert {r.modality for r in mm_store.search(store, q, {"text": 2, "table": 2, "image": 0}).collect()} == {"text", "table"}
    none = mm_store.build(pages.limit(0), buckets=2)
    assert mm_store.search(none, q).count() == 0
