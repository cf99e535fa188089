"""Token ids in ORC files.

Documents are dealt out by range of id, encoded where they lie and written in
ascending id order. ORC encodes the ids as run lengths, patched or packed
integers, keeps minima and maxima by stripe and row group, and a Bloom filter on
the document ids; files are split at stripes when read, and a filter on doc_id
skips files, stripes and row groups by their metadata.

The tokenizer works on stretches between white space: Arrow cuts a piece of texts
into stretches and numbers the different ones, each of which is encoded once by
the library and remembered; the ids are those of the whole text. Of the
remembered stretches those that were not met again for a long time are let go.

Defined results: a null text is empty and has the end id alone; null ids come
first; rows that repeat an id follow each other, dealt to files by a hash of
their text (so a hot id, or none on many rows, fills no single file), and in a
file in order of their ids' checksums. A text of any length is encoded whole.
An empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage

END_ID = 2
ROOM = 400_000          # stretches met in a worker before those not met since are let go
PIECE_BYTES = 20 << 20  # of text looked up at once
ORC = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true",
       "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_FOLDED = bytes.maketrans(b"\t\n\x0b\x0c\r" + bytes(range(65, 91)), b"     " + bytes(range(97, 123)))
_SIGNS = re.compile(rb"(?<=[a-z])([.,;:!?]+)(?= )")  # none of them begins a contraction
_ENCODERS: dict = {}


def cuts_at_signs(description: str) -> bool:
    """Whether a tokenizer (its JSON) lower-cases all text and first of all cuts
    it into runs of letters, of digits and of other signs."""
    t = json.loads(description)
    steps = [(t[k] or {}).get(part, [t[k] or {}]) for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    cut = steps[1][0]
    pattern = (cut.get("pattern") or {}).get("Regex", "") if cut.get("type") == "Split" else ""
    return any(n.get("type") == "Lowercase" for n in steps[0]) and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def bare(description: str):
    """The same tokenizer for words of lower-case ASCII letters, which its
    normalizer leaves as they are and its pattern takes whole: neither is run."""
    from tokenizers import Tokenizer

    t = json.loads(description)
    t["normalizer"] = None
    if "pretokenizers" in t["pre_tokenizer"]:
        t["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    else:
        t["pre_tokenizer"] = {"type": "WhitespaceSplit"}
    return Tokenizer.from_str(json.dumps(t))


class StretchEncoder:
    """Ids of texts, by the ids of their stretches between ASCII white space.

    The tokenizer must treat white space as a border that it drops: ``check``
    compares both ways on a text with every kind of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}   # met lately
        self.before: dict[bytes, bytes] = {}  # met before those
        self.folds = cuts_at_signs(self.tokenizer.to_str())
        self.bare = bare(self.tokenizer.to_str()) if self.folds else None
        (self.mark,) = self.whole("|")
        probe = "A b\tc'd  e\nf 12 café́ ́x\r\x0b\x0c g<|endoftext|> h"
        if self.encode([probe.encode()])[0].tolist() != self.whole(probe):
            raise ValueError("this tokenizer joins text across white space")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def fresh(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit integers: several hundred go through the library as one text,
        with a mark between them that none of them holds."""
        ids: dict[bytes, bytes] = {}
        letters = [w for w in words if w.isalpha()] if self.bare else []  # A-Z and a-z only, and folded
        held = set(letters)
        for tokenizer, some in ((self.bare, letters), (self.tokenizer, [w for w in words if b"|" not in w and w not in held])):
            for lo in range(0, len(some), 500):
                part = some[lo:lo + 500]
                flat = np.array(tokenizer.encode_batch_fast([b" | ".join(part).decode()], add_special_tokens=False)[0].ids, np.int32)
                cuts = np.flatnonzero(flat == self.mark)
                if len(cuts) != len(part) - 1:
                    raise ValueError("the mark between words did not come through")
                data = flat.tobytes()
                first, last = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)]
                ids.update(zip(part, [data[i:j] for i, j in zip(first, last)], strict=True))
        return [ids[w] if w in ids else np.array(self.whole(w.decode()), np.int32).tobytes() for w in words]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, from memory or the library."""
        if len(self.known) > ROOM:
            self.known, self.before = {}, self.known
        known = self.known
        new = [w for w in words if w not in known]
        if self.before:
            known.update({w: self.before[w] for w in new if w in self.before})
            new = [w for w in new if w not in known]
        known.update(zip(new, self.fresh(new), strict=True))
        return list(map(known.__getitem__, words))

    def encode_all(self, texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): all texts' ids one after the other, ``end`` after each."""
        # no text holds a line feed any more; with a tokenizer that folds, letters are
        # lower-cased and signs after a letter cut off, so few forms of a word are encoded
        joined = b" \n ".join([t.translate(_FOLDED if self.folds else _BLANKS) for t in texts] + [b""])
        if self.folds:
            joined = _SIGNS.sub(rb" \1", joined)
        one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(joined)], np.int64)), pa.py_buffer(joined)])
        coded = pc.split_pattern(one, " ").values.dictionary_encode()
        words, at = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
        del one, coded, joined
        special = {b"": b"", b"\n": end}
        where = {w: words.index(w) for w in special if w in words}
        for w, k in where.items():
            words[k] = b"a"  # any word: its ids are not used
        parts = self.ids_of(words)
        for w, k in where.items():
            parts[k] = special[w]
        flat = np.frombuffer(b"".join(parts), np.int32)
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // np.int32(4)
        n = size[at]
        upto = np.cumsum(n, dtype=np.int32)
        shift = (np.cumsum(size, dtype=np.int32) - size)[at] - (upto - n)
        out = flat[np.repeat(shift, n) + np.arange(len(flat) if not len(upto) else upto[-1], dtype=np.int32)]
        ends = upto[at == where[b"\n"]] if texts else upto[:0]
        return np.concatenate([[0], ends]).astype(np.int32), out

    def encode(self, texts: list[bytes], end: bytes = b"") -> list[np.ndarray]:
        offsets, ids = self.encode_all(texts, end)
        return [ids[i:j] for i, j in zip(offsets[:-1], offsets[1:])]


def encoder(path: str) -> StretchEncoder:
    """One encoder in each worker, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = StretchEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) in the order and partitions of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)

        def flush(first, texts):
            offsets, ids = e.encode_all(texts, np.int32(end_id).tobytes())
            return pa.record_batch([b.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "ids"])

        for b in batches:
            held, size, first = [], 0, 0
            for i, t in enumerate(b.column(1)):
                data = t.as_buffer()
                held.append(data.to_pybytes() if data else b"")
                size += len(held[-1])
                if size >= PIECE_BYTES:
                    yield flush(first, held)
                    held, size, first = [], 0, i + 1
            yield flush(first, held)
    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, options: dict | None = None) -> str:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by = ["doc_id", F.xxhash64("text")]
    dealt = d.repartitionByRange(*by).sortWithinPartitions(*by)
    encoded(dealt, tokenizer, end_id).write.options(**ORC, **(options or {})).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids); a condition on doc_id prunes by the files' metadata."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def part_number(file: Column) -> Column:
    """The number in a file's name: the range partitions were numbered in
    ascending order. Names alone sort wrongly from part-100000 on."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files:
    sums by file, moved on by the files before (a row a file), then running sums
    inside each file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names)

    names = ["doc_id", "file", "n_tokens", "ids_crc32"]
    rows = stage(read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file")).mapInArrow(
        run, "doc_id long, file string, n_tokens long, ids_crc32 long"), "orc-spans")
    before = Window.orderBy(part_number(F.col("file")), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("s", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file").select(
        "doc_id", (F.col("s") + F.col("off")).alias("start"), "n_tokens", "ids_crc32")
