"""Operators whose cost must follow the input: results against plain ones on small rows."""

from pyspark.sql import functions as F

from quarry.operators import retrieve as R


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _texts(spark, n=300):
    words = [f"w{i}" for i in range(40)]
    rows = [(None if i == 7 else f"c{i // 2 if i < 20 else i:04d}", f"s{i % 3}" if i % 11 else None,
             " ".join(words[(i * j * j + j) % 40] for j in range(i % 13)) + " common") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, source string, text string")


QUESTIONS = [(1, "common w1 w5 w9"), (2, "w3"), (3, "unknown"), (2, "w3 w4"), (None, "common")]


def test_bm25_indexed_keeps_the_best_without_pairs_of_all(spark, monkeypatch):
    chunks, q = _texts(spark), spark.createDataFrame(QUESTIONS, "qid int, question string")
    index = R.build_term_index(chunks, group="source")
    every = R.bm25(q, chunks)
    assert _rows(R.bm25_indexed(q, index)) == _rows(every)
    monkeypatch.setattr(R._Bm25Cell, "LIMIT", 50)  # reduced many times
    monkeypatch.setattr(R, "CELL_QUESTIONS", 2)
    order = [F.col("score").desc(), F.col("chunk_id")]
    cols = ["qid", "chunk_id", "score", "rank"]
    assert _rows(R.bm25_top(q, index, 4).select(cols)) == _rows(R.top_k(every, 4, ["qid"], order).select(cols))
    # a chunk comes out for each of its groups, and the best of each group are there
    of = chunks.select(F.col("chunk_id").alias("_c"), "source").distinct()
    want = R.top_k(every.join(of, F.col("chunk_id").eqNullSafe(F.col("_c"))), 2, ["qid", "source"], order)
    got = R.top_k(R.bm25_indexed(q, index, k=2, group="source"), 2, ["qid", "source"], order)
    cols = ["qid", "source", "chunk_id", "score"]
    assert _rows(got.select(cols)) == _rows(want.select(cols))


def test_bm25_cells_emit_k_a_question_whatever_the_number_of_chunks(spark):
    chunks = spark.range(4000).select(F.format_string("c%06d", "id").alias("chunk_id"), F.lit("common word").alias("text"))
    q = spark.createDataFrame([(1, "common")], "qid int, question string")
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert R.bm25_indexed(q, R.build_term_index(chunks), k=3).count() <= 3 * cells


def test_bm25_in_scope_counts_each_scope_alone(spark):
    chunks = _texts(spark).withColumn("session_id", F.when(F.col("source") != "s2", F.col("source")))
    q = spark.createDataFrame([(1, "s0", "common w1"), (2, "s1", "w3 w5"), (3, None, "common")], "qid int, session_id string, question string")
    got = R.bm25_in_scope(q, chunks, k=5)
    order = [F.col("score").desc(), F.col("chunk_id")]
    for qid, scope in ((1, "s0"), (2, "s1")):
        alone = R.bm25(q.where(F.col("qid") == qid), chunks.where(F.col("session_id") == scope))
        want = R.top_k(alone, 5, ["qid"], order).select("qid", "chunk_id", "score")
        assert _rows(R.top_k(got.where(F.col("qid") == qid), 5, ["qid"], order).select("qid", "chunk_id", "score")) == _rows(want)
    assert got.where("qid = 3").isEmpty()


def _vectors(spark, n, dup=False):
    import numpy as np
    v = np.random.default_rng(3).normal(size=(n, 8)).astype(float)
    v[n // 2:] = v[:n - n // 2] + 1e-7  # many distances that round to the same
    return spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(n)] * (2 if dup else 1), "chunk_id int, source int, embedding array<double>")


def test_knn_bounds_keep_ties_groups_and_repeated_ids(spark):
    import numpy as np
    for dup in (False, True):
        rows = _vectors(spark, 300, dup).collect()
        v = spark.createDataFrame(rows, "chunk_id int, source int, embedding array<double>")
        q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
        x = np.array([r.embedding for r in rows])
        want, of_group = [], []
        for r in rows:
            if r.chunk_id % 20 == 0:
                d = np.round(np.sqrt(((x - np.array(r.embedding)) ** 2).sum(1)), 6)
                want += [(r.chunk_id, i.chunk_id, float(y)) for i, y in zip(rows, d)]
                of_group += [(r.chunk_id, i.chunk_id, i.source, float(y)) for i, y in zip(rows, d)]
        def best(pairs, key, k):
            out, n = [], {}
            for p in sorted(pairs, key=lambda p: (p[-1], p[1])):
                n[key(p)] = n.get(key(p), 0) + 1
                out += [p] if n[key(p)] <= k else []
            return sorted(out)
        assert [(a, b, round(c, 6)) for a, b, c in _rows_num(R.knn(q, v, 7, sub_batch=16))] == best(want, lambda p: p[0], 7)
        assert _rows_num(R.knn(q, v, 2, group="source", sub_batch=16)) == best(of_group, lambda p: p[::2][:2], 2)


def _rows_num(df):
    return sorted(tuple(r) for r in df.collect())


def test_lsh_moves_no_candidate_pairs(spark):
    from quarry.operators import lsh
    for dup in (False, True):
        v = _vectors(spark, 200, dup)
        q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
        pairs = lsh.candidates(q, v, 4, 3, 7, "qid", "chunk_id", "embedding")
        every = pairs.join(q.withColumnRenamed("embedding", "_qv"), "qid").join(v, "chunk_id").select(
            "qid", "chunk_id", lsh._dist(F.col("_qv"), F.col("embedding")).alias("dist"))
        want = R.top_k(every, 5, ["qid"], [F.col("dist"), F.col("chunk_id")], "r").drop("r")
        got = lsh.knn_lsh(q, v, 5, bits=4, n_tables=3)
        assert _rows_num(got) == _rows_num(want)


def test_long_texts_are_chunked_in_linear_time(spark):
    import time

    from quarry.operators import corpus as C
    short = "a\nß\U0001f600é b" * 5000
    docs = spark.createDataFrame([(1, "s", "x", short), (2, "s", "x", None), (3, "s", "x", ""), (4, "s", "x", "q" * 40000)],
                                 "doc_id long, source string, session_id string, text string")
    for size, overlap in ((1000, 200), (1000, 1)):
        got = [(r.doc_id, r.pos, r.text) for r in C.chunk_fixed(docs, size, overlap).collect()]
        step, want = size - overlap, []
        for r in docs.collect():
            n = max(1, -(-(len(r.text or "") - overlap) // step))
            want += [(r.doc_id, i, None if r.text is None else r.text[i * step:i * step + size]) for i in range(n)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    start = time.time()
    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("session_id"),
                                 F.repeat(F.lit("long text é "), 2_000_000).alias("text"))
    assert C.chunk_fixed(long).agg(F.sum(F.length("text"))).first()[0] > 24_000_000
    assert time.time() - start < 60  # minutes if every chunk counted from the text's start


def test_lsh_takes_rows_without_id_or_vector(spark):
    from quarry.operators import lsh
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    q = v.select(F.col("chunk_id").alias("qid"), "embedding")
    assert _rows_num(lsh.knn_lsh(q, v, 5, bits=1, n_tables=2)) == [(1, 1, 0.0), (1, 2, 0.1), (2, 1, 0.1), (2, 2, 0.0)]


def test_a_batch_without_new_chunks_moves_no_text(spark):
    from quarry.operators import corpus as C
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(i, f"f{i % 3}", f"s{i % 2}", f"text {i} " * 300) for i in range(20)],
                                 "doc_id long, source string, session_id string, text string")
    chunks = C.fingerprint(C.chunk_fixed(docs))
    none = spark.createDataFrame([], "session_id string, fp string")
    cols = ["session_id", "fp", "chunk_id", "text"]
    first = C.add_to_corpus(chunks, none, staged=scratch_path(spark, "ids"))
    assert _rows(first.select(cols)) == _rows(C.add_to_corpus(chunks, none).select(cols)) and not first.isEmpty()
    again = C.add_to_corpus(chunks, first.select("session_id", "fp"), staged=scratch_path(spark, "ids"))
    assert again.columns == first.columns and again.isEmpty()
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


def test_build_corpus_keeps_nothing_uncompressed(spark):
    import glob

    from quarry.operators.build import build_corpus
    from quarry.session import ensure_checkpoint_dir, scratch_path
    docs = spark.createDataFrame([(1, "a.txt", "s", "same words " * 400), (2, "a.txt", "s", "same words " * 400), (3, "b.txt", "s", None)],
                                 "doc_id long, source string, session_id string, text string")
    path = scratch_path(spark, "corpus")
    base = ensure_checkpoint_dir(spark).replace("file://", "").rstrip("/")
    before = set(glob.glob(f"{base}/**/rdd-*", recursive=True))
    added = build_corpus(spark, docs, path)
    assert set(glob.glob(f"{base}/**/rdd-*", recursive=True)) == before
    back = spark.read.parquet(path)
    assert _rows(added.select("session_id", "chunk_id", "fp")) == _rows(back.select("session_id", "chunk_id", "fp")) and back.count() > 1
    assert build_corpus(spark, docs, path).isEmpty() and spark.read.parquet(path).count() == back.count()


def test_many_questions_move_the_best_of_each_part_only(spark, monkeypatch):
    from quarry.operators import postings as P
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:05d}", " ".join(words[(i * j * j + j) % 40] for j in range(i % 9)) + " common") for i in range(1500)]
    chunks = spark.createDataFrame(rows + rows[:200] + [(None, "common w1")], "chunk_id string, text string")  # some ids come twice
    asked = [(i, f"common w{i % 40} w{i * 3 % 40} w{i * 7 % 40}") for i in range(80)]
    q = spark.createDataFrame(asked + asked[:20] + [(None, "common"), (900, None), (901, "unknown")], "qid int, question string")
    cols, order = ["qid", "chunk_id", "score", "rank"], [F.col("score").desc(), F.col("chunk_id")]
    monkeypatch.setattr(P, "MANY", 0)
    for few, part in ((chunks, 700), (chunks.where("chunk_id = 'c00008'"), P.PART)):
        monkeypatch.setattr(P, "PART", part)
        index = P.build_index(few)
        every = index.scores(q).where("qid is not null and chunk_id is not null")
        assert _rows(index.top(q, 4).select(cols)) == _rows(R.top_k(every, 4, ["qid"], order).select(cols))
        parts = max(1, -(-int(index.n * index.avgdl) // part), 4 * spark.sparkContext.defaultParallelism)
        found = index._in_shards(index.asked(q).select("qid", "term", "idf"), 80, 4)
        assert found.count() <= 4 * parts * 82 and every.count() >= 20_000 * (few is chunks)
