"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id, payload digest and URL and written by a batch data
source: each task appends gzip members to files that it rolls by compressed size,
under temporary names of its own; the commit renames the files of the successful
tasks, then writes a manifest of them under a temporary name and renames it, and
removes what failed attempts left. Only files that the manifest names are ever
read, after a check of their sizes and SHA-256. Headers, lengths and digests are
regenerated from the payload, ids and dates are derived, and the bounds of the
ranges follow from the rows alone (their bytes, and the rows whose hash is small),
so that equal input gives equal files, whatever its partitions.

Defined results: a null payload is empty; of equal payloads of at least
``min_payload`` bytes the smallest non-null id (then the smallest URL) is the
response and the others revisit it (rows that repeat that id are responses too;
without any id, all are); a null id sorts first; a null or unprintable URL is
percent-encoded or replaced by ``urn:page:<id>``. Rows that repeat id, URL and
payload are numbered, so every record has an id of its own; they move as one row
for ``COPIES`` of them, and a page or payload that holds much of the table is so
spread over many ranges. Payloads are of any length that a Spark string may have; an
empty table gives an empty manifest and no file; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quarry.llm.common import stage, text_digest

DATE = "1970-01-01T00:00:00Z"   # records carry no clock, lest reruns differ
ROLL_BYTES = 32 << 20
LEVEL = 6
COPIES = 1000  # repeated rows that move as one
SCHEMA = ("page_id long, url string, payload string, refers_to long, refers_url string, digest binary, "
          "start long, copies long")
FIELDS = ["page_id", "url", "payload", "refers_to", "refers_url", "start", "copies"]
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, copy]))}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: str | None, refers_to, refers_url, copy: int = 0) -> bytes:
    body = (payload or "").encode()
    digest = digest_of(body)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id, url, digest, copy)),
               ("WARC-Date", DATE), ("WARC-Target-URI", target_uri(url, page_id)), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}")]
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_uri(refers_to, refers_url, digest, 0)),
                    ("WARC-Refers-To-Target-URI", target_uri(refers_url, refers_to)), ("WARC-Refers-To-Date", DATE),
                    ("Refers-To-Page-ID", str(refers_to))]
    return member(headers, block)


def info_record(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                   ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                   ("WARC-Block-Digest", f"sha1:{digest_of(block)}")], block)


@dataclass
class Written(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int):
        self.path, self.roll, self.job = path.rstrip("/"), roll, uuid.uuid4().hex

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, base = self._fs()
        task = TaskContext.get()
        tmp = f"{base}/_temporary/{self.job}/{task.taskAttemptId()}"
        files, out = [], None
        rows = (row for b in iterator for row in zip(*[b.column(k).to_pylist() for k in FIELDS], strict=True))
        for *row, start, copies in rows:
            for copy in range(start, start + copies):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(files):05d}.warc.gz"
                    fs.create_dir(tmp, recursive=True)
                    out = fs.open_output_stream(f"{tmp}/{name}", compression=None)
                    sha = hashlib.sha256(first := info_record(name))
                    out.write(first)
                    files.append({"file": name, "tmp": f"{tmp}/{name}", "bytes": len(first), "records": 0, "first_id": row[0]})
                data = page_record(*row, copy)
                out.write(data)
                sha.update(data)
                at = files[-1]
                at.update(bytes=at["bytes"] + len(data), records=at["records"] + 1, last_id=row[0], sha256=sha.hexdigest())
                if at["bytes"] >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, base = self._fs()
        fs.create_dir(base, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        for f in files:
            fs.move(f.pop("tmp"), f"{base}/{f['file']}")
        with fs.open_output_stream(f"{base}/_manifest.tmp") as out:
            out.write("".join(json.dumps(f) + "\n" for f in files).encode())
        fs.move(f"{base}/_manifest.tmp", f"{base}/_manifest.jsonl")
        self._clear(fs, base)

    def abort(self, messages) -> None:
        self._clear(*self._fs())

    def _clear(self, fs, base: str) -> None:
        if fs.get_file_info(f"{base}/_temporary/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_temporary/{self.job}")


class WarcShards(DataSource):
    """Write-only: ``df.write.format("warc_shards").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc_shards"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("rollbytes", ROLL_BYTES)))


def archive_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_payload: int = 0) -> DataFrame:
    """Rows of ``SCHEMA``: which page is written whole and which revisits what.

    Ids, URLs and digests are written first, as a narrow table. From it come the
    payloads that occur twice (joined by digest; Spark broadcasts them if their
    size allows) and the rows that repeat another whole, which become one row for
    ``COPIES`` of them. The payloads of all other rows move once, in the range sort."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    p = p.withColumn("digest", text_digest(F.col("payload")))
    same = ["page_id", "url", "digest"]
    keys = stage(p.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(F.coalesce("payload", F.lit("")))).alias("size")),
                 "warc-keys")
    found = F.struct("page_id", "url")
    first = stage(keys.where(F.col("size") >= min_payload).groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), found)).alias("r"), F.sum("n").alias("n")).where("n > 1 and r is not null")
        .select("digest", F.col("r.page_id").alias("first_id"), F.col("r.url").alias("first_url")), "warc-first")
    again = keys.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same], "n")
    rows = p.withColumns({"start": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    if not again.isEmpty():
        match = [p[c].eqNullSafe(again[f"_{c}"]) for c in same]
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
        one = p.join(again, match, "left_semi").groupBy(*same).agg(F.max("payload").alias("payload"))
        many = one.join(again, [one[c].eqNullSafe(again[f"_{c}"]) for c in same]).select(
            "page_id", "url", "payload", "digest", "n", starts.alias("start")).withColumn(
            "copies", F.least(F.col("n") - F.col("start"), F.lit(COPIES).cast("long"))).drop("n")
        rows = rows.join(again, match, "left_anti").unionByName(many)
    other = ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"),
        F.when(other & F.col("first_id").isNotNull(), F.col("first_url")).alias("refers_url"), "digest", "start", "copies")


def ranges_of(size: int) -> int:
    """Ranges for so many bytes of payload: of 8 MB up to 64 ranges, then of up to 256 MB."""
    return max(1, min(64, size >> 23), -(-size >> 28))


def write_archives(plan: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> str:
    """Sort the plan into ranges by (id, digest, copy) and write it under ``path``.

    The bounds are quantiles of the rows whose hash is below a limit (64 a range, 2^20
    in all at most, about): the same for the same rows."""
    spark = plan.sparkSession
    spark.dataSource.register(WarcShards)
    keys = stage(plan.select("page_id", "digest", "start", "copies", F.octet_length("payload").alias("size"),
                             F.pmod(F.xxhash64("page_id", "digest", "url", "start"), F.lit(1 << 40)).alias("h")), "warc-rows")
    n, size = keys.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()
    shards = shards or ranges_of(size)
    limit = (min(64 * shards, 1 << 20) << 40) // max(n, 1)  # a row of many copies is drawn, and counts, as often as they
    sample = sorted((r[0] is not None, r[0] or 0, bytes(r[1]), r[2], max(1.0, r[3] * limit / 2 ** 40)) for r in
                    keys.where(F.col("h") / F.col("copies") <= limit).select("page_id", "digest", "start", "copies").toLocalIterator())
    upto = list(accumulate(r[4] for r in sample))
    bounds = sorted({sample[bisect_right(upto, upto[-1] * k / shards)][:4] for k in range(1, shards)}) if sample else []

    @F.pandas_udf("int")
    def range_of(page_id: pd.Series, null: pd.Series, digest: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, (not z, i, d, a)) for i, z, d, a in
                          zip(page_id.tolist(), null.tolist(), digest.tolist(), start.tolist(), strict=True)], dtype="int32")

    to = range_of(F.coalesce("page_id", F.lit(0)), F.isnull("page_id"), "digest", "start")
    dealt = plan.repartitionById(len(bounds) + 1, to).sortWithinPartitions("page_id", "digest", "start", "url")
    dealt.write.format("warc_shards").option("rollbytes", roll_bytes).mode("append").save(path)
    return path


def manifest_of(path: str) -> list[dict]:
    """The committed files (a line each, so a few MB for a TB of archives). Fails
    without a manifest, or if a file is missing or has another size."""
    fs, base = pafs.FileSystem.from_uri(path.rstrip("/"))
    with fs.open_input_stream(f"{base}/_manifest.jsonl") as f:
        files = [json.loads(line) for line in f.read().decode().splitlines()]
    there = {i.base_name: i.size for i in fs.get_file_info(pafs.FileSelector(base))}
    wrong = [m["file"] for m in files if there.get(m["file"]) != m["bytes"]]
    if wrong:
        raise ValueError(f"archives of the manifest are missing or of another size: {wrong[:5]}")
    return files


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            chunk = view[at:at + (1 << 16)]
            out.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        if not z.eof:
            raise ValueError("a WARC file ends inside a record")
        yield b"".join(out)


def parsed(record: bytes) -> tuple[dict, bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"digest of {headers['WARC-Record-ID']} does not match its block")
    return headers, block


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of the committed files: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to (and payload, null for
    revisits). Each file is one row of the scan; their size is the roll size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sha, content in zip(*b.columns, strict=True):
                rows, data = [], content.as_py()
                if hashlib.sha256(data).hexdigest() != sha.as_py():
                    raise ValueError(f"{name} differs from the manifest")
                for record in members(data):
                    h, block = parsed(record)
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    whole = h["WARC-Type"] == "response"
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and (len(payload), digest_of(payload)) != (size, digest):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its headers")
                    rows.append((*(int(h[k]) if k in h else None for k in ("Page-ID", "Refers-To-Page-ID")), h["WARC-Target-URI"],
                                 size, digest, h["WARC-Type"], payload.decode() if whole and with_payload else None))
                    if len(rows) == 2000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names = ["page_id", "refers_to", "url", "payload_bytes", "payload_digest", "record_type", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = "page_id long, refers_to long, url string, payload_bytes long, payload_digest string, record_type string, payload string"
    files = manifest_of(path)
    if files:
        listed = spark.createDataFrame([(m["file"], m["sha256"]) for m in files], "file string, sha256 string")
        listed = F.broadcast(listed) if len(files) <= 1 << 16 else listed  # 100 bytes a file
        base = path.rstrip("/")
        scan = spark.read.format("binaryFile").load([f"{base}/{m['file']}" for m in files])
        out = scan.select(F.substring_index("path", "/", -1).alias("file"), "content").join(listed, "file").select(
            "file", "sha256", "content").mapInArrow(run, schema)
    else:
        out = spark.createDataFrame([], schema)
    return out if with_payload else out.drop("payload")
