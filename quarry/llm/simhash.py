"""SimHash near-duplicates by bit-sliced comparison.

Documents with one fingerprint are one node. Two fingerprints that differ in at
most r bits agree on two of r + 2 blocks of bits, so nodes are dealt out by the
value of each pair of blocks; a key that too many nodes share is refined by the
pieces of its free bits (of r + 1 pieces one agrees), which bounds every group
by the number of values its last free bits can take, and loses no pair. Inside
a group the fingerprints lie as 64 vertical bit planes; row i is compared with
row i + d for all i at once, differences are added by carry-save counters, and
words of 64 lanes are dropped as soon as all of their lanes exceed the radius.

A task sends one row per linked fingerprint (to the least of its local
component), never the pairs, and components are merged by alternating star
steps on written tables.

Defined results: a null or empty text has fingerprint zero, which is linked like
any other; repeated rows get the same answer; component_id is the smallest
non-null id of the component, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage, text_bytes

RADIUS = 2
SHINGLE = 3
SEED = 42
GROUP = 4096            # nodes that may share a key before it is refined
PIECE = 1 << 16         # shingles hashed, and rows compared, at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' hashes; a long text is hashed in pieces."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    ones = np.zeros(64, np.int64)
    while True:
        h = np.fromiter(map(xxhash.xxh64_intdigest, islice(grams, PIECE), repeat(seed)), np.uint64)
        if not len(h):
            break
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED, digest: Column | None = None) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long, and the row's binary ``digest`` if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(text_bytes(t.as_py()), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *more])

    more = [] if digest is None else ["digest"]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([digest.alias("digest")] if more else []))
    return d.mapInArrow(run, "doc_id long, fp long" + (", digest binary" if more else ""))


def split_bits(bits: list[int], n: int) -> list[int]:
    """``bits`` in n masks of nearly equal width."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), n)]


def first_masks(radius: int) -> list[int]:
    return [a | b for a, b in combinations(split_bits(list(range(64)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in split_bits(free, radius + 1) if m]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 bit planes: bit i of plane b is bit b of fp[i]; one spare word of zeros."""
    n = -(-len(fp) // 64) * 64 + 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes_within(planes: np.ndarray, valid: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Rows i whose fingerprint differs from that of row i + d in at most
    ``radius`` bits, among the lanes set in ``valid`` (packed).

    The counters start so that radius + 1 differences overflow them; two planes
    at a time go through a full adder with the lowest counter bit."""
    q, s = np.uint64(d // 64), np.uint64(d % 64)
    at = np.flatnonzero(valid).astype(np.uint64)
    over = ~valid[at]
    levels = max(1, radius.bit_length())
    bias = (1 << levels) - 1 - radius
    counter = [np.full(len(at), ALL if bias >> k & 1 else np.uint64(0)) for k in range(levels)]

    def differ(b: int) -> np.ndarray:
        p = planes[b]
        other = p[at + q] >> s
        if s:
            other |= p[np.minimum(at + q + np.uint64(1), np.uint64(len(p) - 1))] << (np.uint64(64) - s)
        return p[at] ^ other

    for b in range(0, 64, 2):
        if b and b % 8 == 0:
            alive = over != ALL
            if not alive.all():
                at, over, counter = at[alive], over[alive], [c[alive] for c in counter]
        if not len(at):
            break
        x, y = differ(b), differ(b + 1)
        half = x ^ y
        carry = (x & y) | (half & counter[0])
        counter[0] = counter[0] ^ half
        for k in range(1, levels):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over = over | carry
    if not len(at):
        return np.empty(0, np.int64)
    lane = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(at), 64)
    w, bit = np.nonzero(lane)
    return at[w].astype(np.int64) * 64 + bit


def local_roots(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group: the row that stands for each row's component
    under the links inside its group. Groups are laid out by falling size, so
    that a distance d concerns a prefix of the rows."""
    _, first, inverse, sizes = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    size, place = sizes[inverse], np.arange(len(fp)) - first[inverse]
    order = np.lexsort((place, inverse, -size))
    size, place, planes = size[order], place[order], planes_of(fp[order])
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d in range(1, int(size.max(initial=1))):
        n = int(np.searchsorted(-size, -d))  # rows of groups with more than d rows
        ok = np.zeros(-(-n // 64) * 64, np.uint8)
        ok[:n] = place[:n] + d < size[:n]
        i = lanes_within(planes, np.packbits(ok, bitorder="little").view(np.uint64), d, radius)
        i = i[parent[i] != parent[i + d]]
        if len(i):
            for a in i.tolist():
                x, y = root(a), root(a + d)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = up
    out = np.empty_like(parent)
    out[order] = order[parent]
    return out


def local_links(radius: int):
    """mapInArrow body over rows sorted by (mask, key): one row per fingerprint
    that is linked to another, with the one that stands for its component."""
    def found(fp, group):
        r = local_roots(fp, group, radius)
        has = r != np.arange(len(r))
        if has.any():
            yield pa.record_batch([pa.array(fp[has].view(np.int64)), pa.array(fp[r[has]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
            n += b.num_rows
            if n < PIECE:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held, n = [rows[:, cut:]], rows.shape[1] - cut
            if cut:
                yield from found(*grouped(rows[:, :cut]))
        if held and n:
            yield from found(*grouped(np.concatenate(held, axis=1)))

    def grouped(rows):
        new = np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])
        return np.ascontiguousarray(rows[2]).view(np.uint64), np.cumsum(new)
    return run


def links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(u, v) over the different fingerprints ``nodes`` (fp): links that leave
    every component connected."""
    masks = first_masks(radius)
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    parts = []
    for level in range(3):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        n = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        company = stage(rows.join(n, ["mask", "key"]), "simhash-groups")
        finer = {m: finer_masks(m, radius) for m in masks}
        if level == 2 or not all(len(x) > 1 for x in finer.values()):
            parts.append(company)
            break
        parts.append(company.where(F.col("n") <= group))
        hot = company.where(F.col("n") > group)
        if hot.isEmpty():
            break
        table = F.create_map(*[x for m, c in finer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in c]))])
        rows = hot.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        masks = sorted({x for c in finer.values() for x in c})
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)
    dealt = dealt.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(local_links(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component, by
    alternating large-star and small-star steps. Each step takes a minimum per
    node (combined on the map side) and joins it back; each round is written."""
    def lowest(pairs: DataFrame) -> DataFrame:
        m = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(m.select("u", F.least("u", "m").alias("m")), "u")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = lowest(large)
        small = down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "star")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                   shingle: int = SHINGLE, seed: int = SEED, group: int = GROUP, digest: Column | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``; with
    ``digest`` also that and root, which tells components without an id apart."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle, seed, digest), "simhash-fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius, group))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, "simhash-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(least, "root").select("fp", "component_id", "root")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                                          *([] if digest is None else ["digest", "root"]))
