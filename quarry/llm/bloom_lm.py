"""Bigram language model in a log-frequency Bloom filter.

The filter holds quantised counts: a bigram seen c times is entered once for
each level 1 .. 1 + floor(log2 c), and its count is read by probing level after
level until one is missing. Every probe of a bigram falls in one block of the
filter, so that a task builds whole blocks from the bigrams dealt to it and
nothing has to be merged. The filter has a fixed number of bits for each
training token; above ``MAX_FILTER`` bytes it is cut into several filters, each
broadcast and scored in a pass of its own over the tokens whose bigram it holds
(scores are sums over tokens, so the passes add up exactly).

The probability interpolates: (1 - BACKOFF') c(v w) / c(v) + BACKOFF' p1(w),
with p1 the smoothed word probability. Word counts are exact. The ``HOT_WORDS``
most frequent words at most are broadcast as two number arrays; tokens that need
another word's count are joined with the counts by word. Words are told apart by
64-bit hashes.

Defined results: a null text is an empty one, whose only token is its end; a
null id is held out (its text form is empty); repeated rows each get the same
answer and each count in training; without training texts every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix, stage, text_bytes, word_hashes

ALPHA = 0.1             # added to each count in p1
BACKOFF = 0.7           # share of p1 in the interpolation
HOT_WORDS = 1 << 20     # 16 bytes each in the broadcast
BITS_PER_TOKEN = 5      # about 12 per different bigram
MAX_FILTER = 96 << 20   # bytes of one broadcast filter
BLOCK_BITS = 18         # bits of a block as a power of two
TASK_TOKENS = 2_000_000  # training tokens whose bigrams one task turns into blocks
PIECE = 400_000         # tokens worked on at once

U = np.uint64
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")  # no word has these bytes
BASE = U(0x9E3779B97F4A7C15)


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, offsets, token hashes): runs of whole texts of about
    ``PIECE`` tokens, each text ended by ``END``."""
    for b in batches:
        held, first, n = [], 0, 0
        for i, t in enumerate(b.column(column)):
            h = word_hashes(text_bytes(t.as_py()).lower().split())
            held.append(np.append(h, U(END)))
            n += len(held[-1])
            if n >= PIECE or i == b.num_rows - 1:
                yield b, first, np.cumsum([0, *map(len, held)]), np.concatenate(held)
                held, first, n = [], i + 1, 0


def histories(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    v = np.concatenate([[U(START)], tokens[:-1]])
    v[offsets[:-1]] = U(START)
    return v


def bigrams(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * BASE + w)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (((keys >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)


def probes(keys: np.ndarray, level: int, part: int) -> Iterator[np.ndarray]:
    """Bit positions inside the block for (bigram, level): three in each of two parts."""
    x = mix(keys + U((2 * level + part) * int(BASE) & (1 << 64) - 1))
    for k in range(3):
        yield ((x >> U(k * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)).view(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def expected(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 1, 2.5, 5.5, ..."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level) - 1) / 2, 0.0)


def filled_blocks(keys: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """The bits of every block that one of the bigrams belongs to."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    keys, level = keys[first], levels_of(np.add.reduceat(counts, first)) if len(first) else counts
    at = block_of(keys, blocks)
    ids, where = np.unique(at, return_inverse=True)
    for lo in range(0, len(ids), 64):  # 64 blocks at a time: 16 MB of flags
        mine = (where >= lo) & (where < lo + 64)
        k, q, base = keys[mine], level[mine], (where[mine] - lo) << BLOCK_BITS
        flags = np.zeros(min(64, len(ids) - lo) << BLOCK_BITS, np.uint8)
        j = 1
        while len(k):
            for part in (1, 2):
                for p in probes(k, j, part):
                    flags[base + p] = 1
            j += 1
            more = q >= j
            k, q, base = k[more], q[more], base[more]
        packed = np.packbits(flags, bitorder="little").reshape(-1, 1 << (BLOCK_BITS - 3))
        for i, bits in enumerate(packed):
            yield int(ids[lo + i]), bits.tobytes()


def stored_levels(bits: np.ndarray, keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Level read for each bigram: probes go on only for those still present
    after each three."""
    out = np.zeros(len(keys), np.int64)
    live, base = np.arange(len(keys)), block << BLOCK_BITS
    level = 1
    while len(live) and level < 64:
        for part in (1, 2):
            found = np.ones(len(live), np.uint8)
            for p in probes(keys, level, part):
                at = base + p
                found &= bits[at >> 3] >> (at & 7).astype(np.uint8)
            keep = np.flatnonzero(found)
            live, keys, base = live[keep], keys[keep], base[keep]
        out[live] = level
        level += 1
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): exact counts of the training tokens, by hash; each task sends
    a row per word and piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, tokens in pieces(batches, 0):
            w, n = np.unique(tokens, return_counts=True)
            yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(n)], ["word", "c"])
    return train.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bigram_blocks(train: DataFrame, tokens: int, blocks: int) -> DataFrame:
    """(block, bits) of the filter. Pieces send a row per different bigram, so a
    hot bigram arrives once per piece; a task holds about ``TASK_TOKENS`` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, offsets, t in pieces(batches, 0):
            k, n = np.unique(bigrams(histories(t, offsets), t), return_counts=True)
            yield pa.record_batch([pa.array(block_of(k, blocks).astype(np.int32)), pa.array(k.view(np.int64)),
                                   pa.array(n.astype(np.int32))], ["block", "key", "c"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(1).to_numpy().view(U), b.column(2).to_numpy().astype(np.int64)) for b in batches if b.num_rows]
        if held:
            for at, bits in filled_blocks(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), blocks):
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

    tasks = max(1, -(-tokens // TASK_TOKENS))
    dealt = train.select("text").mapInArrow(count, "block int, key long, c int").repartition(tasks, "block")
    return dealt.mapInArrow(fill, "block int, bits binary")


def hot_counts(counts: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words and counts of the most frequent words, at most ``room``: all those
    of at least 2**k tokens, with the least k that fits."""
    by_level = dict(counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect())
    least, n = 64, 0
    for k in sorted(by_level, reverse=True):
        n += by_level[k]
        if n > room:
            break
        least = k
    rows = counts.where(F.floor(F.log2("c")) >= least).toArrow()
    word, c = (rows.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(word.view(U))
    return word.view(U)[order], c[order], least


def token_scores(docs: DataFrame, hot, bits, shard: int, shards: int, blocks: int, denominator: float, starts: int,
                 backoff: float) -> DataFrame:
    """One pass: for each row of docs (``rk``) a row of the sums over the tokens
    that need hot words only, and a row for each other token, with the counts
    that are known (null: to be joined)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = hot.value
        table = bits.value
        words = np.append(words, U(0xFFFFFFFFFFFFFFFF))
        counts = np.append(counts, 0)
        for b, first, offsets, w in pieces(batches, 1):
            n = len(offsets) - 1
            row = np.repeat(np.arange(n), np.diff(offsets))
            different, which = np.unique(w, return_inverse=True)
            at = np.searchsorted(words[:-1], different)
            c = np.where(words[at] == different, counts[at], -1)[which]
            v = histories(w, offsets)
            cv = np.concatenate([[starts], c[:-1]])
            cv[offsets[:-1]] = starts
            keys = bigrams(v, w)
            block = block_of(keys, shards * blocks)
            if shards > 1:
                mine = block // blocks == shard
                row, w, v, c, cv, keys, block = (x[mine] for x in (row, w, v, c, cv, keys, block))
            bc = expected(stored_levels(table, keys, block - shard * blocks))
            open_ = (c < 0) | ((cv < 0) & (bc > 0))
            bc_known = np.minimum(np.minimum(bc, c), cv)
            p1 = (np.maximum(c, 0) + ALPHA) / denominator
            p = np.where((bc_known > 0) & (cv > 0), backoff * p1 + (1 - backoff) * bc_known / np.maximum(cv, 1), backoff * p1)
            def total(x):
                return np.bincount(row[~open_], x[~open_], n)
            rk = b.column(0).slice(first, n)
            yield pa.record_batch(
                [rk, pa.array(np.ones(n, np.int32)), pa.array(np.bincount(row, minlength=n)),
                 pa.array(total((c > 0).astype(float)).astype(np.int64)), pa.array(total(np.log10(p1))),
                 pa.array(total(np.log10(p))), *[pa.nulls(n, k) for k in kinds[6:]]], names)
            o = np.flatnonzero(open_)
            if len(o):
                m = len(o)
                yield pa.record_batch(
                    [rk.take(pa.array(row[o])), pa.array(np.zeros(m, np.int32)), *[pa.nulls(m, k) for k in kinds[2:6]],
                     pa.array(w[o].view(np.int64)), pa.array(c[o], mask=c[o] < 0), pa.array(v[o].view(np.int64)),
                     pa.array(cv[o], mask=cv[o] < 0), pa.array(bc[o])], names)

    names = ["rk", "whole", "n", "known", "base", "score", "w", "cw", "v", "cv", "bc"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(),
             pa.int64(), pa.float64()]
    return docs.select("rk", "text").mapInArrow(
        run, "rk long, whole int, n long, known long, base double, score double, w long, cw long, v long, cv long, bc double")


def score_texts(docs: DataFrame, train_rule, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS,
                max_filter: int = MAX_FILTER, bits_per_token: int = BITS_PER_TOKEN, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, trained_on, n_tokens, n_known, train_tokens, base_score, score),
    one row per row of ``docs``; ``train_rule`` is a condition on doc_id."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text", train_rule.alias("trained_on"))
    train = d.where("trained_on")
    counts = stage(word_counts(train), "lm-words")
    n_train, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    starts = counts.where(F.col("word") == int(np.array([END], U).view(np.int64)[0])).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    denominator = n_train + ALPHA * (vocabulary + 1)

    per_filter = max_filter >> (BLOCK_BITS - 3)
    wanted = max(1, -(-n_train * bits_per_token >> BLOCK_BITS))
    shards = -(-wanted // per_filter)
    blocks = -(-wanted // shards)
    table = stage(bigram_blocks(train, n_train, shards * blocks), "lm-filter")
    words, word_c, least = hot_counts(counts, hot_words)
    hot = spark.sparkContext.broadcast((words, word_c))
    passes = None
    for s in range(shards):
        bits = np.zeros(blocks << (BLOCK_BITS - 3), np.uint8)
        for at, x in table.where(F.col("block").between(s * blocks, (s + 1) * blocks - 1)).toLocalIterator():
            lo = (at - s * blocks) << (BLOCK_BITS - 3)
            bits[lo:lo + len(x)] = np.frombuffer(x, np.uint8)
        one = token_scores(d, hot, spark.sparkContext.broadcast(bits), s, shards, blocks, denominator, starts, backoff)
        if shards > 1:
            one = stage(one, "lm-pass")
        passes = one if passes is None else passes.unionByName(one)

    cold = counts.where(F.floor(F.log2("c")) < least)
    # rows of sums join nothing: their key is a hash of their own, spread over all partitions
    e = passes.withColumn("jw", F.when(F.col("w").isNull() | F.col("cw").isNotNull(), F.xxhash64("rk", "v", "w")).otherwise(F.col("w")))
    e = e.join(cold.select(F.col("word").alias("jw"), F.col("c").alias("c1")), "jw", "left").drop("jw")
    e = e.withColumn("cw", F.when(F.col("cw").isNull(), F.coalesce("c1", F.lit(0))).otherwise(F.col("cw"))).drop("c1")
    need = (F.col("whole") == 0) & F.col("cv").isNull() & (F.col("bc") > 0) & (F.col("cw") > 0)
    e = e.withColumn("jv", F.when(need, F.col("v")).otherwise(F.xxhash64("rk", "w", "v")))
    e = e.join(cold.select(F.col("word").alias("jv"), F.col("c").alias("c2")), "jv", "left")
    cv = F.when(need, F.coalesce("c2", F.lit(0))).otherwise(F.coalesce("cv", F.lit(0)))
    e = e.withColumn("cv", cv).withColumn("bc", F.least("bc", "cw", "cv"))
    p1 = (F.col("cw") + F.lit(ALPHA)) / F.lit(float(denominator))
    p = F.lit(backoff) * p1 + F.when((F.col("bc") > 0) & (F.col("cv") > 0), F.lit(1 - backoff) * F.col("bc") / F.col("cv")).otherwise(0.0)
    token = F.col("whole") == 0
    sums = e.groupBy("rk").agg(
        F.sum("whole").alias("rows"), F.sum("n").alias("n"), F.sum(F.when(token, (F.col("cw") > 0).cast("long")).otherwise(F.col("known"))).alias("known"),
        F.sum(F.when(token, F.log10(p1)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(token, F.log10(p)).otherwise(F.col("score"))).alias("score"))
    times = F.col("rows") / F.lit(shards)  # rows that repeat a document were summed together
    s = sums.select("rk", (F.col("n") / times).cast("long").alias("n_tokens"), (F.col("known") / times).cast("long").alias("n_known"),
                    (F.col("base") / times).alias("base_score"), (F.col("score") / times).alias("score"))
    return d.select("rk", "doc_id", "trained_on").join(s, "rk").select(
        "doc_id", "trained_on", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
