"""Substring deduplication with an FM-index per shard.

A window is ``WINDOW`` consecutive words of a document. Every window belongs to
the least k-gram hash inside it, its anchor; a run of windows with one anchor is
a segment. Equal windows have equal anchors, so segments meet by anchor:

1. anchors that occur once are dropped, and equal segments are combined to their
   earliest occurrence before anything else moves (all windows of the others
   start earlier there);
2. anchors with different segments are dealt out to shards. Each shard builds an
   FM-index of its segments (suffix array, Burrows-Wheeler transform, wavelet
   matrix of packed bits) and streams them against it: backward search from each
   window's last word gives its matching statistic, the length matched elsewhere
   too, and intervals that reach the threshold are reported with the earliest
   position among their occurrences;
3. an anchor with more than ``HOT`` different segments, such as the edge of a
   passage that very many documents share, would overfill a shard; its windows
   are compared by their hashes in an aggregation instead.

Defined results: a null or empty text has no words; a word is compared unchanged;
documents are ordered by id, null ids first, and those of one id by the hash of
their text. Different texts of one id are documents of their own, and so is every
row with a null id; rows that repeat a non-null id with its text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, mix, stage, text_bytes, word_hashes

WINDOW = 20
GRAM = 8                # words in an anchor
HOT = 2048              # different segments that may share an anchor in a shard
SHARD = 16384           # segments aimed at in a shard
FILTER_BITS = 1 << 24   # of the filter that keeps untouched texts out of a join
BASE = np.uint64(0x9E3779B97F4A7C15)
KEY = ["doc_id", "part"]  # of a document: its id and the hash of its text

U = np.uint64


def polynomial(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(h) - width + 1
    out = np.zeros(max(0, n), U)
    for k in range(width):
        out = out * BASE + h[k:k + n]
    return mix(out)


def least_positions(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, the leftmost of equals, of each run."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(v[right] < v[left], right, left)
        have += step
    return at


def segments(h: np.ndarray, window: int, gram: int):
    """(start, windows, anchor, hash) of the segments of one document."""
    grams = polynomial(h, gram)
    at = least_positions(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    # sums of h[i] * BASE**-i, times BASE**start: a hash that does not depend on the place
    power = np.concatenate([[U(1)], np.cumprod(np.full(len(h), BASE_INVERSE, U))])
    total = np.concatenate([[U(0)], np.cumsum(h * power[:-1], dtype=U)])
    end = first + count + window - 1
    scale = np.concatenate([[U(1)], np.cumprod(np.full(len(h), BASE, U))])[first]
    return first, count, grams[at[first]], mix((total[end] - total[first]) * scale + end.astype(U) - first.astype(U))


BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))


class FmIndex:
    """FM-index of a sequence of symbols 1..sigma-1 with 0 between its parts."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, k = text.astype(np.int64), 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (int(nxt.max(initial=0)) + 1) + nxt
            sa = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[sa[1:]] != key[sa[:-1]])])
            rank[sa] = new
            k *= 2
            if k >= depth or k >= n or new[-1] == n - 1:
                break
        self.sa = sa
        bwt = text[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = []
        for bit in reversed(range(max(1, int(text.max(initial=0)).bit_length()))):
            ones = (bwt >> bit) & 1
            words = np.packbits(np.concatenate([ones, np.zeros(-n % 64 + 64, ones.dtype)]).astype(np.uint8), bitorder="little").view(U)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = n - int(ones.sum())
            self.levels.append((bit, words, before, zeros))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        symbols = np.arange(len(self.start) - 1)
        self.base = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Position i of the transform, followed through the wavelet matrix."""
        for bit, words, before, zeros in self.levels:
            w, r = i >> 6, (i & 63).astype(U)
            one = before[w] + np.bitwise_count(words[w] & ((U(1) << r) - U(1)))
            i = np.where((c >> bit) & 1, zeros + one, i - one)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of c + pattern, given those of the patterns."""
        at = self.start[c] - self.base[c]
        both = self._down(np.concatenate([c, c]), np.concatenate([low, high]))
        return at + both[: len(c)], at + both[len(c):]


def matching_statistics(index: FmIndex, text: np.ndarray, ends: np.ndarray, threshold: int):
    """For each end position: the words matched leftwards as long as the match
    occurs at least twice, up to ``threshold``, and the interval where it ended."""
    low, high = index.start[text[ends]].copy(), index.start[text[ends] + 1].copy()
    length = (high - low >= 2).astype(np.int64)
    live = np.flatnonzero(length)
    for k in range(1, threshold):
        if not len(live):
            break
        c = text[ends[live] - k]
        a, b = index.extend(c, low[live], high[live])
        go = (b - a >= 2) & (c > 0)  # a match ends where its part of the text begins
        live = live[go]
        low[live], high[live] = a[go], b[go]
        length[live] = k + 1
    return length, low, high


def shard_repeats(doc: np.ndarray, start: np.ndarray, words: list[np.ndarray], window: int):
    """(doc, start) of the windows of a shard's segments that also start earlier."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate(words)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(len(flat) + len(words), np.int64)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(words)), sizes)
    text[place] = np.unique(flat, return_inverse=True)[1] + 1
    index = FmIndex(text, depth=2 * window)
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    position = start[owner] + np.arange(len(text)) - begin[owner]
    rank = np.empty(len(text), np.int64)
    order = np.lexsort((position, doc[owner]))
    same = (doc[owner][order][1:] == doc[owner][order][:-1]) & (position[order][1:] == position[order][:-1])
    rank[order] = np.concatenate([[0], np.cumsum(~same)])  # one place that two segments hold counts as one
    counts = sizes - window + 1
    first = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    length, low, high = matching_statistics(index, text, first + window - 1, window)
    hit = np.flatnonzero(length >= window)
    if not len(hit):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lows, which = np.unique(low[hit], return_inverse=True)  # intervals of one length are disjoint
    highs = np.zeros(len(lows), np.int64)
    highs[which] = high[hit]
    by_row = np.append(rank[index.sa], np.iinfo(np.int64).max)
    earliest = np.minimum.reduceat(by_row, np.stack([lows, highs], 1).ravel())[::2][which]
    late = first[hit][rank[first[hit]] != earliest]
    return doc[owner[late]], position[late]


def document_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per row of docs: doc_id and part, a number of the row, n_words, the
    hash of its words joined by one blank, and the segments as arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(2):
                words = text_bytes(t.as_py()).split()
                parts = segments(word_hashes(words), window, gram) if len(words) >= window else [np.empty(0, U)] * 4
                rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), *parts))
            n, sha, first, count, anchor, seg = zip(*rows, strict=True) if rows else [[]] * 6
            lists = [pa.array([x.astype(kind) if kind != np.int64 else x.view(np.int64) for x in col], pa.list_(to))
                     for col, kind, to in ((first, np.int32, pa.int32()), (count, np.int32, pa.int32()),
                                           (anchor, np.int64, pa.int64()), (seg, np.int64, pa.int64()))]
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *lists], names)

    names = ["doc_id", "part", "row", "n_words", "sha", "start", "n", "anchor", "seg"]
    numbered = docs.select(*KEY, "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, "doc_id long, part long, row long, n_words long, sha string, start array<int>, "
                                    "n array<int>, anchor array<long>, seg array<long>")


def touched(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """Rows of ``docs`` that may have a key of ``wanted``: a bit per hashed key,
    ``bits`` in all whatever the input, tested where the text lies. A full
    filter lets every row through to the join, which decides."""
    at = F.pmod(F.xxhash64(*KEY), F.lit(bits)) + 1  # bitmap_bucket_number is 1-based over positions 1..32768
    maps = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    flags = np.zeros(bits // 8 + 4096, np.uint8)
    for k, m in maps:
        flags[(k - 1) * 4096:(k - 1) * 4096 + len(m)] |= np.frombuffer(m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def may(bucket: pd.Series, bit: pd.Series) -> pd.Series:
        k = (bucket.to_numpy() - 1) * 32768 + bit.to_numpy()
        return pd.Series((shared.value[k >> 3] >> (k & 7)) & 1 == 1)
    return docs.where(may(F.bitmap_bucket_number(at), F.bitmap_bit_position(at)))


def repeated_windows(docs: DataFrame, found: DataFrame, window: int, gram: int, hot: int, shard: int, bits: int) -> DataFrame:
    """(doc_id, part, start, n): runs of windows that also start earlier."""
    place = F.struct(*KEY, "start")
    seg = found.select(*KEY, F.explode(F.arrays_zip("start", "n", "anchor", "seg")).alias("x")).select(*KEY, "x.*")
    met = seg.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("c > 1")
    seg = stage(seg.join(met.select("anchor", (F.col("lo") != F.col("hi")).alias("many")), "anchor"), "fm-segments")
    firsts = stage(seg.groupBy("anchor", "seg").agg(F.min(place).alias("f"), F.first("n").alias("n"),
                                                    F.first("many").alias("many"), F.count(F.lit(1)).alias("c")), "fm-firsts")
    later = seg.join(firsts.where("c > 1").select("anchor", "seg", "f"), ["anchor", "seg"]).where(
        place != F.col("f")).select(*KEY, "start", "n")

    many = firsts.where("many").groupBy("anchor").agg(F.count(F.lit(1)).alias("k"))
    wanted = firsts.where("many").join(many, "anchor").select("f.*", "n", "anchor", (F.col("k") > hot).alias("hot"))
    by_doc = stage(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("want")), "fm-wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("anchor", *KEY, "start", "words")}
            for d, p, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                h = word_hashes(text_bytes(t.as_py()).split())
                wins = polynomial(h, window) if len(h) >= window else h[:0]
                for w in want.as_py():
                    s, n = w["start"], w["n"]
                    out["anchor"].append(w["anchor"])
                    out["doc_id"].append(d)
                    out["part"].append(p)
                    out["start"].append(s)
                    # a hot anchor's windows go by their hashes, shown by a row with fewer words than a window
                    out["words"].append(wins[s:s + n].view(np.int64) if w["hot"] else h[s:s + n + window - 1].view(np.int64))
                if len(out["start"]) > 20_000:
                    yield pa.record_batch(list(map(pa.array, out.values(), kinds)), list(out))
                    out = {k: [] for k in out}
            yield pa.record_batch(list(map(pa.array, out.values(), kinds)), list(out))

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    rows = stage(touched(docs, by_doc, bits).join(by_doc, KEY).select(*KEY, "text", "want").mapInArrow(
        fetch, "anchor long, doc_id long, part long, start int, words array<long>").distinct(), "fm-rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        doc, part, start = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for k in (1, 2, 3))
        words = [x.values.to_numpy(zero_copy_only=False).view(U) for b in held for x in b.column(4)]
        order = np.lexsort((part, doc))
        doc, part = doc[order], part[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(new) - 1
        d, s = shard_repeats(rank, start, words, window)
        yield pa.record_batch([pa.array(doc[new][d]), pa.array(part[new][d]), pa.array(s.astype(np.int32)),
                               pa.array(np.ones(len(d), np.int32))], [*KEY, "start", "n"])

    full = F.size("words") >= window
    shards = max(1, -(-rows.where(full).count() // shard))
    matched = rows.where(full).repartition(shards, "anchor").mapInArrow(search, "doc_id long, part long, start int, n int")

    wins = rows.where(~full).select(*KEY, F.posexplode("words").alias("k", "w"), "start").select(
        "w", *KEY, (F.col("start") + F.col("k")).alias("start"))
    low = wins.groupBy("w").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hot_later = wins.join(low, "w").where(place != F.col("f")).select(*KEY, "start", F.lit(1).alias("n"))
    return later.unionByName(matched).unionByName(hot_later)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                 hot: int = HOT, shard: int = SHARD, bits: int = FILTER_BITS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``;
    ``with_text`` adds the kept words, joined by one blank (null where nothing
    was removed: the text stands as it is)."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("part"), F.col(text_col).alias("text"))
    found = stage(document_segments(d, window, gram), "fm-documents")
    spans = repeated_windows(d, found, window, gram, hot, shard, bits)
    by_doc = stage(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans")), "fm-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, p, t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words = text_bytes(t.as_py()).split()
                at = np.array([(x["start"], x["n"]) for x in spans.as_py()], np.int64)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 0] + at[:, 1] + window - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)
                out.append((d, p, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names, kinds = [*KEY, "n_removed", "kept_sha", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    new = touched(d, by_doc, bits).join(by_doc, KEY).select(*KEY, "text", "spans").mapInArrow(
        cut, "doc_id long, part long, n_removed long, kept_sha string, kept string").dropDuplicates(KEY)
    # of equal texts without an id, all rows but one are whole repeats of that one
    one = found.where(F.col("doc_id") == NULL_ID).groupBy("part").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("one"))
    out = found.select(*KEY, "row", "n_words", "sha").join(new, KEY, "left").join(one, "row", "left")
    again = (F.col("doc_id") == NULL_ID) & F.col("one").isNull() & (F.col("n_words") >= window)
    cols = [F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_words",
            F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256")]
    return out.select(*cols, *([F.when(again, F.lit("")).otherwise(F.col("kept")).alias("text")] if with_text else []))
