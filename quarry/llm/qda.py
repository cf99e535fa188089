"""Quality classifier: regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. For each class the mean
and covariance come from distributed sums over all labelled training rows; the
covariances are shrunk towards the pooled one and towards a multiple of the
identity, and factored once. A document's score is the logistic of the scaled
difference of the classes' log densities, each a Mahalanobis distance solved
with the cached Cholesky factor.

Defined results: a null text is an empty one, which has a vector like any other;
rows without a label or with a label other than 0 and 1 are scored but not
learned from; several labels of one id count as their rounded mean; with one
class only, every score is that class's side of 0.5 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage, text_bytes

TO_POOLED = 0.1         # shrinkage of a class covariance towards the pooled one
TO_IDENTITY = 0.02      # ... and then towards its mean variance times the identity
TEMPERATURE = 8.0       # divides the log-density difference: the statistics are not independent
THRESHOLD = 0.7

#: Sets of bytes whose share of the text is a statistic.
CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "marks": b"#*$%&|<>@^~=+_{}[]\\/", "loud": b"!?",
    "stops": b".,;:", "blank": b" \t", "quote": b"\"'`()", "high": bytes(range(128, 256)),
}
#: So many usual characters are added to a text, with these shares of the classes.
USUAL, USUAL_SHARE = 120, np.array([0.025, 0.004, 0.002, 0.002, 0.025, 0.15, 0.002, 0.02])
_MEMBER = np.array([[c in members for c in range(256)] for members in CLASSES.values()], np.float64)
NAMES = ["words", "word_len", "line_len", "distinct", "short", "long", "dup_lines", "top_word", *CLASSES]


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text: logarithms of sizes, and
    logarithms of shares, so that junk lies far from prose. Every share starts
    from some usual characters, words and lines, lest a short text look odd."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    share = (_MEMBER @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) + USUAL_SHARE * USUAL) / (size + USUAL)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lexical = [
        np.log1p(n), np.log1p(lengths.mean() if n else 0.0), np.log1p(size / max(1, len(lines))),
        np.log((len(distinct) + 20) / (n + 20) ** 0.9), ((lengths <= 3).sum() + 8) / (n + 20),
        np.log(((lengths >= 15).sum() + 0.5) / (n + 20)),
        np.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 5)),
        np.log((max(distinct.values(), default=0) + 1) / (n + 20)),
    ]
    return np.concatenate([lexical, np.log(share)])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """(doc_id, x): an array of ``NAMES`` for each row, and its binary ``digest`` if given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(text_bytes(t.as_py())) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64())), *b.columns[2:]], ["doc_id", "x", *more])

    more = [] if digest is None else ["digest"]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([digest.alias("digest")] if more else []))
    return d.mapInArrow(run, "doc_id long, x array<double>" + (", digest binary" if more else ""))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and offsets, over standardised x."""

    centre: np.ndarray
    scale: np.ndarray
    parts: dict     # label -> (mean, inverse factor, minus half the log determinant, log prior)
    temperature: float = TEMPERATURE

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """The scaled log-density difference plus that of the log priors."""
        z = (x - self.centre) / self.scale
        out = np.zeros(len(x))
        for label, sign in ((1, 1.0), (0, -1.0)):
            if label not in self.parts:
                return np.full(len(x), -sign if self.parts else 0.0)
            mean, inverse, offset, prior = self.parts[label]
            out += sign * ((offset - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1)) / self.temperature + prior)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 30)))


def fit(train: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY,
        temperature: float = TEMPERATURE) -> Discriminant:
    """``train`` has x and y (0 or 1). Two aggregations over all rows: centre
    and scale, then each class's sums of z and of z z' (a few hundred numbers
    come back, whatever the input)."""
    p = len(NAMES)
    x = [F.get("x", i) for i in range(p)]
    first = train.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    if first[0] is None:
        return Discriminant(np.zeros(p), np.ones(p), {}, temperature)
    centre, scale = np.array(first[:p], float), np.maximum(np.array(first[p:], float), 1e-6)
    z = train.select("y", *[((c - F.lit(float(m))) / F.lit(float(s))).alias(f"z{i}")
                            for i, (c, m, s) in enumerate(zip(x, centre, scale, strict=True))])
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = {r[0]: r for r in z.groupBy("y").agg(
        F.count(F.lit(1)), *[F.sum(f"z{i}") for i in range(p)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in upper]).collect()}
    total = sum(r[1] for r in sums.values())
    means, covs = {}, {}
    for y, r in sums.items():
        n, means[y] = r[1], np.array(r[2:2 + p], float) / r[1]
        s = np.zeros((p, p))
        for (i, j), v in zip(upper, r[2 + p:], strict=True):
            s[i, j] = s[j, i] = v / n
        covs[y] = s - np.outer(means[y], means[y])
    pooled = sum(sums[y][1] * covs[y] for y in covs) / total
    parts = {}
    for y, c in covs.items():
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * (max(np.trace(c) / p, 1e-6)) * np.eye(p)
        low = np.linalg.cholesky(c)
        parts[y] = (means[y], np.linalg.inv(low), float(-np.log(np.diag(low)).sum()),
                    float(np.log(sums[y][1] / total)))
    return Discriminant(centre, scale, parts, temperature)


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` (doc_id, x) with their score. The model is a few kilobytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(NAMES)))
            yield pa.record_batch([b.column(0), pa.array(model.score(x)), *b.columns[2:]], ["doc_id", "score", *more])
    more = [c for c in rows.columns if c == "digest"]
    return rows.select("doc_id", "x", *more).mapInArrow(run, "doc_id long, score double" + (", digest binary" if more else ""))


def held_out(id_col: str = "doc_id"):
    """Rows kept from the training: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, digest: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``, and its
    ``digest`` if given. The texts are read once; their vectors are written and used for both steps."""
    x = stage(features(docs, id_col, text_col, digest), "qda-features")
    y = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.round(F.avg("quality")).cast("int").alias("y"))
    model = fit(x.where(~held_out()).join(y, "doc_id").select("x", "y"))
    return scored(x, model).select("doc_id", held_out().alias("held_out"), "score",
                                   (F.col("score") >= threshold).cast("int").alias("predicted"),
                                   *([] if digest is None else ["digest"]))
