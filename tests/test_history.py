"""Chat memory of long conversations, and its stream."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import conversation as CV
from quarry.session import scratch_path
from quarry.streaming import history_stream as H

rnd = random.Random(4)
CONV = "conv_id long, turn long, role string, text string"


def turns(conv, n, step=1):
    return [(conv, t * step, rnd.choice(["user", "assistant", None]), rnd.choice([f" t{t}", "", None, "\t"]) if t % 3 else f"t{t} ") for t in range(n)]


ROWS = turns(1, 100) + turns(2, 33, 1000) + turns(3, 5) + turns(None, 20) + [(4, None, "user", "first"), *turns(4, 14)]


@pytest.fixture(scope="module")
def conv(spark):
    return spark.createDataFrame(ROWS, CONV).repartition(3)


def by_conversation():
    out = {}
    for r in ROWS:
        out.setdefault(r[0], []).append(r)
    return {c: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0)) for c, v in out.items()}


def history_brute(n):
    for c, rows in by_conversation().items():
        for k, (_, t, role, text) in enumerate(rows):
            before = rows[max(0, k - n):k]
            lines = [("User: " if r == "user" else "Assistant: ") + x.strip() for _, _, r, x in before if (x or "").strip()]
            said = [x.strip() for _, _, r, x in before if r == "user" and (x or "").strip()]
            yield (c, t, "\n".join(lines), len(lines), text if not said else None if text is None else said[-1] + " " + text)


@pytest.mark.parametrize("n,block", [(12, 16), (12, 1), (3, 7), (12, 1 << 12)])
def test_blocks_with_halo_change_no_row(conv, n, block):
    want = sorted(history_brute(n), key=repr)
    got = CV.rolling_history(conv, n, block).select("conv_id", "turn", "history", "n_history").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    alone = CV.contextualize(conv, n, block).select("conv_id", "turn", "standalone").collect()
    assert sorted((tuple(r) for r in alone), key=repr) == sorted(((c, t, s) for c, t, _, _, s in want), key=repr)


def test_a_long_conversation_is_many_window_partitions(spark):
    rows = spark.range(100_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    sizes = CV.with_halo(rows, 12, 1000).groupBy("_conv", "_block").count().agg(F.count("count"), F.max("count")).first()
    assert sizes[0] in (100, 101) and sizes[1] <= 1012
    assert CV.rolling_history(rows, 12, 1000).where("n_history = 12").count() == 100_000 - 12


def test_no_conversations(conv):
    assert CV.rolling_history(conv.where("false")).isEmpty() and CV.contextualize(conv.where("false")).isEmpty()


# ---- stream

def newest(rows, keep):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, {}).setdefault(t, (role, text))
    return sorted(((c, t, *v) for c, m in out.items() for t, v in sorted(m.items(), key=lambda kv: (kv[0] is not None, kv[0] or 0))[-keep:]), key=repr)


def write(spark, src, rows):
    spark.createDataFrame(rows, CONV).coalesce(1).write.mode("append").parquet(src)


def buffers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_restart_and_replay(spark):
    src, root, ckpt = (scratch_path(spark, x) for x in ("h-src", "h-root", "h-ck"))
    first = [r for r in ROWS if r[1] is None or r[1] % 2 == 0]
    second = [r for r in ROWS if r not in first] + [(1, 4, "user", "late, and known"), (9, 1, "user", "new")]
    write(spark, src, first[::-1])
    assert buffers(H.stream_history(spark, src, CONV, root, ckpt)) == newest(first, 12)
    H.fold(spark, root, ckpt)
    assert buffers(H.history(spark, root, ckpt)) == newest(first, 12)
    write(spark, src, second)
    want = newest(first + second, 12)
    assert buffers(H.stream_history(spark, src, CONV, root, ckpt)) == want  # goes on
    assert buffers(H.stream_history(spark, src, CONV, root, ckpt)) == want  # nothing new
    again = scratch_path(spark, "h-ck")
    assert buffers(H.stream_history(spark, src, CONV, root, again)) == want  # from the start
    assert buffers(H.history(spark, root, ckpt)) == want


def test_a_batch_writes_only_what_it_touches(spark):
    src, root, ckpt = (scratch_path(spark, x) for x in ("h-src", "h-root", "h-ck"))
    write(spark, src, ROWS)
    H.stream_history(spark, src, CONV, root, ckpt, keep=5)
    write(spark, src, [(3, 100, "user", "more")])
    got = H.stream_history(spark, src, CONV, root, ckpt, keep=5)
    updates = spark.read.parquet(H._folder(root, ckpt) + "/updates")
    assert {r.conv_id for r in updates.where("epoch = 1").collect()} == {3}
    assert buffers(got) == newest([*ROWS, (3, 100, "user", "more")], 5)


def test_history_of_nothing(spark):
    root, ckpt = scratch_path(spark, "h-root"), scratch_path(spark, "h-ck")
    H.fold(spark, root, ckpt)
    assert H.history(spark, root, ckpt).isEmpty()
