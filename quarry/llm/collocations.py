"""Phrase collocations by Toivonen's sampling algorithm.

A phrase can only be frequent if the two phrases one word shorter in it are. A
sample of the documents proposes phrases: those that reach a lowered threshold
there. A pass over all documents then counts the proposed phrases and their
negative border, which is every phrase that was not proposed though its two
shorter phrases were (every word, for words). A phrase of the border that turns
out to be frequent is a failure of the sample: phrases that hold it may be
frequent and uncounted. So what was found joins the proposals, and another pass
counts the border that this adds, until no frequent phrase is missing from the
proposals. A wrong or empty sample costs passes (at most as many as a phrase has
words), never results.

The border is never listed. A phrase is counted where both shorter phrases
stand in the proposals, which tasks hold as one bit array a length, sized by the
sample's proposals and of ``BITS`` bits at most, whatever the corpus. These
passes count by 64-bit hashes of phrases, so most of what they shuffle (phrases
that turn out to be rare) is one number a phrase. Two phrases on one hash or one
bit add a phrase to what is counted and lose none; a last pass counts those that
were found by the phrase itself, so the results are exact.

Scale: a pass reads the texts in their scan tasks, where Arrow cuts the words
and numpy counts the different phrases of each ``CHUNK`` bytes. Hashes go out
packed by range, 12 bytes each, and a range, sized by the sample, is added up in
one task; a frequent phrase is one number a chunk there. Arrays only gain bits,
and a later pass leaves out what the bits of the pass before let through, so
nothing is counted twice. Counts of a pass are written with those below the
threshold left out. Scores come from joins of the exact counts, the best phrases
of a language from two steps, the first of which is dealt by hash, so no
language is one task's.

Defined results: a null text has no words, a null language is ``und``; every row
counts, repeated rows and ids as well. Empty tables give no rows. Texts are read
whole; a very long one is a chunk of its own. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mix, stage

BITS = 1 << 27  # most bits for the proposals of one phrase length: 16 MB
PER_PHRASE = 16  # bits for each phrase that the sample proposes, up to BITS
CHUNK = 1 << 23  # bytes of text counted at a time
SAMPLE = 8  # one document in so many proposes
BREAKS = b".,;:!?\x0b\x0c\r"  # with the line feed: no phrase goes across
_PLAIN = bytes.maketrans(BREAKS + b"\t" + bytes(range(65, 91)), b"\n" * len(BREAKS) + b" " + bytes(range(97, 123)))
COUNTS = "lang string, k int, phrase string, n long"
BUCKETS = 1 << 11  # ranges of hashes that are added up apart, at least
BUCKET_BYTES = 1 << 25  # of a range, by the sample's estimate
_LENGTH = 7  # the low bits of a phrase's hash are its number of words


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, int]:
    """(number of each token, the different tokens, number that stands for a
    break): lower-cased words, with a break between pieces and texts."""
    text = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ")
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
    coded = pc.split_pattern(one, " ").values.dictionary_encode()
    ids, words = coded.indices.to_numpy(), coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    return ids[ids != blank], words, pc.index(words, pa.scalar("\n", words.type)).as_py()


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


def keyed(whole: np.ndarray, k: int) -> np.ndarray:
    return (whole & ~np.uint64(_LENGTH)) | np.uint64(k)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(3)) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def both(flags: np.ndarray) -> np.ndarray:
    """Flag of each place and the next together."""
    return flags[:-1] & flags[1:]


class Chunk:
    """Phrases of some texts of one language, by the place of their first word."""

    def __init__(self, texts: list[bytes], lang: str):
        self.ids, self.words, stop = tokens(texts)
        self.word = self.ids != stop
        self.seed = lang_seed(lang)

    def lengths(self, longest: int) -> Iterator[tuple]:
        """(k, places that hold a phrase, hash at each place)."""
        each = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer(), self.seed) for w in self.words), np.uint64, len(self.words))[self.ids]
        valid, whole = self.word, each
        for k in range(1, longest + 1):
            if k > 1:
                valid, whole = valid[:-1] & self.word[k - 1:], longer_hash(whole[:-1], each[k - 1:])
            yield k, valid, whole

    def counted(self, longest: int, now: list | None, before: list | None) -> Iterator[tuple]:
        """(keys, counts) of phrases whose shorter phrases have their bits in
        ``now`` (None: all) and did not have them in ``before`` (None: none)."""
        inner: dict = {}  # of the length before: phrases whose own bits are set as well
        for k, valid, whole in self.lengths(longest):
            key = keyed(whole, k)
            let = {}
            for name, bits in (("now", now), ("before", before)):
                if bits is not None:
                    let[name] = valid & both(inner[name]) if k > 1 else valid
                    if k < longest:
                        inner[name] = let[name] & has_bit(bits[k - 1], key)
            new = let.get("now", valid)
            if "before" in let:
                new = new & ~let["before"]
            found = key[new]
            found.sort()
            if len(found):
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                yield found[first], np.diff(np.append(first, len(found)))

    def exact(self, longest: int, bits: list) -> Iterator[tuple]:
        """(k, phrases, counts) of the phrases with their bits in ``bits``, by
        the words themselves, and the number of words as that of k = 0."""
        yield 0, pa.array([""], pa.large_string()), np.array([np.count_nonzero(self.word)])
        width = max(len(self.words) - 1, 1).bit_length()
        for k, valid, whole in self.lengths(longest):
            at = np.flatnonzero(valid)
            at = at[has_bit(bits[k - 1], keyed(whole[at], k))]
            if len(at):
                rows, n = distinct([self.ids[at + j].astype(np.int64) for j in range(k)], width)
                parts = [self.words.take(pa.array(r)) for r in rows]
                yield k, parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", self.words.type)), n


def distinct(columns: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of ``columns`` of ``bits``-bit numbers, and how often each occurs."""
    if len(columns) * bits <= 63:  # packed into one number, which sorts fastest
        key = columns[0].copy()
        for c in columns[1:]:
            key = (key << bits) | c
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, size = key[first], len(key)
        rows = [(key >> (bits * (len(columns) - 1 - j))) & ((1 << bits) - 1) for j in range(len(columns))]
    else:
        order = np.lexsort(columns[::-1])
        rows = [c[order] for c in columns]
        size = len(order)
        first = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in rows], axis=0))
        rows = [c[first] for c in rows]
    return rows, np.diff(np.append(first, size))


def by_chunk(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work(texts, lang)`` -> record batches, over chunks of each language's texts."""
    held: dict[str, list] = {}
    size = 0
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1)
        for k, lang in enumerate(langs):
            data = texts[k].as_buffer()
            data = data.to_pybytes() if data else b""  # a copy: what is held does not keep the batch
            held.setdefault(lang, []).append(data)
            size += len(data) + 1
            if size >= CHUNK:
                for x in held:
                    yield from work(held[x], x)
                held, size = {}, 0
        del b, texts  # before the next one is read
    for x in held:
        yield from work(held[x], x)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def hash_counts(docs: DataFrame, longest: int, least: int, now=None, before=None, buckets: int = BUCKETS) -> DataFrame:
    """(h, n) of one pass, n >= ``least``; ``now`` and ``before`` are broadcast bit
    arrays. A chunk's different hashes go out sorted and packed, a row for each of
    ``buckets`` ranges of hashes; a range's rows meet in one task, which adds them."""
    shift = 64 - (buckets - 1).bit_length()

    def work(texts: list[bytes], lang: str) -> Iterator[pa.RecordBatch]:
        found = list(Chunk(texts, lang).counted(longest, now and now.value, before and before.value))
        if found:
            keys, n = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order].astype(np.uint32)
            first = np.flatnonzero(np.diff(keys >> np.uint64(shift), prepend=np.uint64(1) << np.uint64(63)))
            rows = [keys[a:z].tobytes() + n[a:z].tobytes() for a, z in zip(first, [*first[1:], len(keys)])]
            yield pa.record_batch([pa.array((keys[first] >> np.uint64(shift)).astype(np.int64)), pa.array(rows, pa.binary())], ["b", "data"])

    def add(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 12) for x in parts])
        n = np.concatenate([np.frombuffer(x, np.uint32, offset=len(x) // 12 * 8) for x in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n[order].astype(np.int64), first)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for _, group in groupby(rows, key=lambda r: r[0]):
            keys, n = add([data for _, data in group])
            yield pa.record_batch([pa.array(keys[n >= least].view(np.int64)), pa.array(n[n >= least])], ["h", "n"])

    packed = texts_of(docs).mapInArrow(lambda batches: by_chunk(batches, work), "b long, data binary")
    return packed.repartition("b").sortWithinPartitions("b").mapInArrow(sums, "h long, n long")


def phrase_counts(docs: DataFrame, longest: int, bits) -> DataFrame:
    """``COUNTS`` of the phrases with their bits in the broadcast arrays."""
    def work(texts: list[bytes], lang: str) -> Iterator[pa.RecordBatch]:
        for k, phrases, n in Chunk(texts, lang).exact(longest, bits.value):
            for first in range(0, len(n), 1 << 16):
                part = phrases.slice(first, 1 << 16).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), k, np.int32)), part,
                                       pa.array(n[first:first + len(part)].astype(np.int64))], ["lang", "k", "phrase", "n"])
    rows = texts_of(docs).mapInArrow(lambda batches: by_chunk(batches, work), COUNTS)
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def empty_bits(found: DataFrame, longest: int) -> list:
    """A bit array for each number of words up to ``longest``, sized by the number of hashes ``found``."""
    size = min(BITS, max(1 << 16, 1 << (PER_PHRASE * found.count()).bit_length()))
    return [np.zeros(size // 8, np.uint8) for _ in range(longest)]


def with_bits(earlier: list, found: DataFrame) -> list:
    """``earlier`` and the bits of the hashes ``found``; at most BITS a length reach the driver."""
    out = [x.copy() for x in earlier]
    size = 8 * len(out[0])
    at = found.select(F.col("h").bitwiseAND(_LENGTH).alias("k"), (F.shiftrightunsigned("h", 3).bitwiseAND(size - 1) + 1).alias("at"))
    maps = at.groupBy("k", F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    for k, b, m in maps.toLocalIterator():  # positions start at 1, as do the buckets
        out[k - 1][(b - 1) * 4096:(b - 1) * 4096 + len(m)] |= np.frombuffer(m, np.uint8)
    return out


def without_bit(found: DataFrame, shared) -> DataFrame:
    """Hashes that the proposals do not hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy().view(np.uint64)
            held = np.zeros(len(keys), bool)
            for k, bits in enumerate(shared.value, 1):
                mine = (keys & np.uint64(_LENGTH)) == k
                held[mine] = has_bit(bits, keys[mine])
            yield b.filter(pa.array(~held))
    return found.select("h").mapInArrow(run, "h long")


def lowered(least: int, rate: int, risk: float = 0.01) -> int:
    """The sample's threshold: a phrase of ``least`` occurrences is below it with
    a chance of about ``risk`` (Chernoff), but at least 2: once says nothing."""
    mean = least / rate
    return max(2, math.ceil(mean - math.sqrt(2 * mean * math.log(1 / risk))))


def frequent_hashes(docs: DataFrame, least: int, longest: int, rate: int) -> tuple[DataFrame, int]:
    """(h, n) of the phrases that may occur ``least`` times (all that do, and any
    that share their hash), and the passes made."""
    context = docs.sparkSession.sparkContext
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0)
    seen = stage(hash_counts(few, longest - 1, lowered(least, rate)), "phrases-sample")
    words = rate * (seen.where(F.col("h").bitwiseAND(_LENGTH) == 1).agg(F.sum("n")).first()[0] or 0)
    buckets = max(BUCKETS, 1 << (12 * longest * words // BUCKET_BYTES).bit_length())
    bits, shared, found = with_bits(empty_bits(seen, longest - 1), seen), [None], []
    while True:
        shared.append(context.broadcast(bits))
        found.append(stage(hash_counts(docs, longest, least, shared[-1], shared[-2], buckets), "phrases-pass"))
        inner = found[-1].where(F.col("h").bitwiseAND(_LENGTH) < longest)
        if without_bit(inner, shared[-1]).isEmpty():
            break
        bits = with_bits(bits, inner)
    for b in shared[1:]:
        b.destroy()
    return functools.reduce(DataFrame.unionByName, found), len(found)


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, rate: int = SAMPLE) -> tuple[DataFrame, int]:
    """(``COUNTS`` of all phrases of up to ``longest`` words that occur ``least``
    times or more, and of k = 0, the number of words of a language; passes made
    to find them). ``rate``: one document in so many is in the sample, by hash."""
    if not 2 <= longest <= _LENGTH:
        raise ValueError(f"phrases have 2 to {_LENGTH} words")
    found, passes = frequent_hashes(docs, least, longest, rate)
    bits = docs.sparkSession.sparkContext.broadcast(with_bits(empty_bits(found, longest), found))
    counts = stage(phrase_counts(docs, longest, bits).where((F.col("n") >= least) | (F.col("k") == 0)), "phrases-exact")
    bits.destroy()
    return counts, passes


def part_of(words: Column, first, size) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words or more at its
    weakest cut, in exact integers: floor(10^6 a a / (l r)), ties to the first cut."""
    known = counts.where("k > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", part_of(words, 1, F.col("cut")).alias("_l"), part_of(words, F.col("cut") + 1, F.size(words)).alias("_r"))
    for side, name in (("_l", "l"), ("_r", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    return weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of each phrase within a longer one, the most occurrences of such a one."""
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part_of(words, i, m))))
    return counts.where("k > 2").select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, covered: int = 50, top: int = 2000, rate: int = SAMPLE,
                 spread: int = 64) -> DataFrame:
    """Each language's ``top`` phrases by score, then occurrences, then phrase:
    (lang, rank, phrase, a, l, r, n, score). A phrase is left out if a longer one
    around it has ``covered`` percent of its occurrences or more. ``spread``:
    hashed shares of a language that are ranked apart before its final ranking."""
    counts, _ = frequent_phrases(docs, least, longest, rate)
    best = scored_phrases(counts).join(inside_longer(counts), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    for by in (["lang", share], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", F.col("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
