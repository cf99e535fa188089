"""Corpus building: chunking, fingerprints, incremental dedup, manifests.

Input is a ``docs`` DataFrame with at least ``(doc_id, source, session_id,
text)``. All operators are narrow projections except where noted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import exprs as X

# Default budget of the reference's splitter.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
LONG_TEXT = 1 << 15  # characters


def chunk_fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                keep: tuple[str, ...] = ("doc_id", "source", "session_id")) -> DataFrame:
    """Fixed windows of ``size`` characters, step ``size - overlap``.

    Narrow (no shuffle): each document is cut in place with ``sequence`` +
    ``posexplode``; a 20k-word document never leaves its partition."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(step))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda i: F.substring(F.col("text"), i * step + 1, size))
    part = math.gcd(step, size)
    if size // part <= 16:
        # ``substring`` counts from the start each time: long texts are cut into parts in one pass
        parts = F.array(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{part}}}"), F.lit(0)))
        joined = F.element_at(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(
            *[F.coalesce(F.get(p, i * (step // part) + j), F.lit("")) for j in range(size // part)]))), 1)
        pieces = F.when(F.length("text") > LONG_TEXT, joined).otherwise(pieces)
    return (docs.select(*keep, F.posexplode(pieces).alias("pos", "text"))
            .withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("pos"))))


def chunk_id(doc_id, pos):
    return F.concat(doc_id.cast("string"), F.lit("-"), F.lpad(pos.cast("string"), 19, "0"))


def fingerprint(df: DataFrame, text: str = "text", source: str | None = "source",
                row_id: str | None = None) -> DataFrame:
    """``src::row_id`` when both exist, else ``src::sha256(text)``, else
    ``sha256(text)``."""
    h = F.sha2(F.col(text), 256)
    # a re-upload gets another suffix: the cleaned name is what identifies a file
    src = clean_filename(X.basename(source)) if source else F.lit(None).cast("string")
    rid = F.col(row_id).cast("string") if row_id else F.lit(None).cast("string")
    fp = F.coalesce(F.concat(src, F.lit("::"), rid),
                    F.concat(F.coalesce(F.concat(src, F.lit("::")), F.lit("")), h))
    return df.withColumn("fp", fp)


def incremental_new_chunks(new: DataFrame, ledger: DataFrame,
                           keys: tuple[str, ...] = ("session_id", "fp")) -> DataFrame:
    """Chunks whose (session, fingerprint) is not in the ledger yet.

    In-batch copies collapse to the smallest chunk_id (deterministic). The
    collapse is a partial+final aggregate, so a fingerprint repeated a
    billion times is combined map-side before the shuffle. The anti-join
    shuffles on the same keys, so the aggregate's partitioning is reused."""
    first = new.groupBy(*keys).agg(F.min("chunk_id").alias("chunk_id"))
    return first.join(ledger.select(*keys), list(keys), "left_anti")


def add_to_corpus(new: DataFrame, ledger: DataFrame,
                  keys: tuple[str, ...] = ("session_id", "fp"), staged: str | None = None) -> DataFrame:
    """Full rows of the chunks that J1 admits (anti-join placed before any
    expensive embed step). With ``staged`` the admitted keys are written there
    first: a batch that holds nothing new then moves no text."""
    ids = incremental_new_chunks(new, ledger, keys)
    if staged:
        ids.write.parquet(staged)
        ids = new.sparkSession.read.schema(ids.schema).parquet(staged)
        if ids.isEmpty():
            return new.where(F.lit(False)).select(*keys, "chunk_id", *[c for c in new.columns if c not in (*keys, "chunk_id")])
    return new.join(ids, list(keys) + ["chunk_id"], "left_semi")


def file_manifest(chunks: DataFrame, by: str = "session_id", name_col: str = "name") -> DataFrame:
    """A10: ``n file(s): a, b, c`` over sorted distinct clean file names.

    Distinct (session, name) first, so the per-session list holds one entry
    per file, not per chunk."""
    names = chunks.select(by, clean_filename(X.basename(F.col("source"))).alias("n")).distinct()
    agg = names.groupBy(by).agg(F.array_sort(F.collect_list("n")).alias("names"))
    return agg.select(
        by,
        F.size("names").alias("n_files"),
        F.when(F.size("names") == 0, F.lit("(no files indexed)"))
         .otherwise(F.concat(F.size("names").cast("string"), F.lit(" file(s): "),
                             F.array_join("names", ", "))).alias(name_col))


def distinct_sources(chunks: DataFrame, by: str = "session_id", approx: bool = False) -> DataFrame:
    """Per session the number of distinct sources and of chunks."""
    nd = F.approx_count_distinct("source") if approx else F.countDistinct("source")
    return chunks.groupBy(by).agg(nd.alias("n_sources"), F.count(F.lit(1)).alias("n_chunks"))


def list_sessions(corpus: DataFrame) -> DataFrame:
    """Sessions present in the corpus (a partition-column scan when the
    corpus is stored ``partitionBy('session_id')``)."""
    return corpus.select("session_id").distinct()


def keep_latest_sessions(corpus: DataFrame, keep: int = 3) -> DataFrame:
    """Rows of the ``keep`` newest sessions (session names sort by time).

    The newest sessions come from a top-k over the distinct session list
    (per-partition limit, then merge; no single-partition window), and the
    semi-join keeps the corpus scan partition-pruned."""
    newest = corpus.select("session_id").distinct().orderBy(F.col("session_id").desc()).limit(keep)
    return corpus.join(newest, "session_id", "left_semi")


def clean_filename(c):
    """Drop the ``_<6 hex>`` upload suffix before the extension."""
    return F.regexp_replace(c, r"_[0-9a-f]{6}(\.[^.]+)$", "$1")


def safe_filename(c):
    """Non ``[a-zA-Z0-9_-]`` -> ``_`` on the stem, lower-cased."""
    return F.lower(F.regexp_replace(X.stem(c), r"[^a-zA-Z0-9_\-]", "_"))


# The twelve accepted upload extensions.
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".txt", ".pptx", ".md", ".csv", ".xlsx",
                        ".xls", ".db", ".sqlite", ".sqlite3", ".json"]


def filter_supported(files: DataFrame, name: str = "name") -> DataFrame:
    """Keep files whose lower-cased extension is supported."""
    return files.where(X.extension(F.col(name)).isin(SUPPORTED_EXTENSIONS))


def needs_ocr(pages: DataFrame, min_chars: int = 20) -> DataFrame:
    """A page with fewer than ``min_chars`` characters after strip is a
    scanned page; count per file (partial aggregation, one shuffle)."""
    scanned = F.length(X.strip(F.col("text"))) < min_chars
    return pages.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(scanned).alias("n_scanned"))


def section_marked(pages: DataFrame, kind: str = "Page", drop_blank: bool = False) -> DataFrame:
    """One marked section per page: ``\\n--- Page n ---\\n`` + text.

    ``page_no`` (1-based) must already be on the rows (see
    ``quarry.operators.skew.ordinal``) so no window spans a whole file."""
    df = pages
    if drop_blank:
        df = df.where(X.strip(F.col("text")) != "")
    return df.withColumn("section", F.concat(
        F.lit(f"\n--- {kind} "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("text")))


# ---------------------------------------------------------------------------
# Recursive splitting (paragraph > line > word > character)
# ---------------------------------------------------------------------------

# Separators tried in order.
SEPARATORS = ["\n\n", "\n", " ", ""]


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Greedily pack pieces (each <= size) into windows <= size, carrying a
    tail of at most ``overlap`` characters into the next window."""
    out, cur, total = [], [], 0
    for p in pieces:
        extra = len(p) + (len(sep) if cur else 0)
        if cur and total + extra > size:
            out.append(sep.join(cur))
            while cur and (total > overlap or total + len(p) + len(sep) > size):
                total -= len(cur[0]) + (len(sep) if len(cur) > 1 else 0)
                cur.pop(0)
        cur.append(p)
        total += len(p) + (len(sep) if len(cur) > 1 else 0)
    if cur:
        out.append(sep.join(cur))
    return out


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    seps: list[str] = SEPARATORS) -> list[str]:
    if text is None:
        return []
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next(s for s in seps if s == "" or s in text)
    rest = seps[seps.index(sep) + 1:]
    pieces = text.split(sep) if sep else list(text)
    out, run = [], []
    for p in pieces:
        if len(p) <= size:
            run.append(p)
            continue
        if run:
            out.extend(_merge(run, sep, size, overlap))
            run = []
        out.extend(split_recursive(p, size, overlap, rest) if rest else
                   [p[i:i + size] for i in range(0, len(p), size - overlap)])
    if run:
        out.extend(_merge(run, sep, size, overlap))
    return [c.strip() for c in out if c.strip()]


def chunk_recursive(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    keep: tuple[str, ...] = ("doc_id", "source", "session_id")) -> DataFrame:
    """Arrow-batched splitter (pandas UDF) + ``posexplode``; narrow."""
    from quarry.functions.udfs import recursive_splitter
    split = recursive_splitter(size, overlap)
    return (docs.select(*keep, F.posexplode(split(F.col("text"))).alias("pos", "text"))
            .withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("pos"))))
