"""Model hooks: embeddings, cached batch inference, output validation.

Hosted models are replaced by pluggable batch callables run inside
``mapInPandas`` (Arrow batches, built once per Python worker), each with a
deterministic default so every job runs offline.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Embeddings


def embed_chunks(chunks: DataFrame, num_features: int = 1 << 12, text: str = "text",
                 embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Text -> unit vector ``embedding ARRAY<FLOAT>``.

    Default: ``RegexTokenizer -> HashingTF -> IDF -> Normalizer`` (Spark ML;
    IDF is one distributed pass). ``embed`` replaces it with a user batch
    function applied per Arrow batch."""
    if embed is not None:
        schema = T.StructType(chunks.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(it):
            for pdf in it:
                pdf = pdf.copy()
                pdf["embedding"] = [list(map(float, v)) for v in embed(pdf[text].fillna("").tolist())]
                yield pdf
        return chunks.mapInPandas(run, schema)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)])
    model = pipe.fit(chunks)
    out = model.transform(chunks)
    return out.withColumn("embedding", vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_idf", "_vec")


# Cached batch inference


def default_generate(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a hosted model: the first line of the
    prompt's context block."""
    out = []
    for p in prompts:
        body = p.split("Context:\n", 1)[-1]
        out.append(next((ln.strip() for ln in body.splitlines() if ln.strip()), ""))
    return out


def batch_infer_cached(prompts: DataFrame, cache: DataFrame | None, model: str,
                       fn: Callable[[list[str]], list[str]] = default_generate,
                       prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Identical (model, prompt) pairs are computed once: key = sha256 of
    model + prompt; distinct keys; anti-join the cache; run ``fn`` on the
    misses only; answer every row by joining back. Returns (answers,
    new_cache_rows) - the caller appends the latter to its cache table."""
    keyed = prompts.withColumn("key", F.sha2(F.concat(F.lit(model + "\u0000"), F.col(prompt)), 256))
    todo = keyed.select("key", prompt).dropDuplicates(["key"])
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("output", T.StringType())])

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"key": pdf["key"], "output": fn(pdf[prompt].tolist())})
    fresh = todo.mapInPandas(run, schema)
    known = fresh if cache is None else cache.select("key", "output").unionByName(fresh)
    return keyed.join(known, "key", "left"), fresh


# Output validation


def validate_json(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Parse model output against a fixed schema; rows that do not parse, miss a
    field or hold a value of another type are flagged ``valid = false``
    (quarantine) instead of failing the job."""
    struct = T.StructType.fromDDL(schema)
    bad = "_corrupt_record"
    parsed = F.from_json(F.col(raw), T.StructType([*struct.fields, T.StructField(bad, T.StringType())]),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    whole = parsed.isNotNull() & parsed[bad].isNull()
    for f in struct.fieldNames():
        whole = whole & parsed[f].isNotNull()
    record = F.when(parsed.isNotNull(), F.struct(*[parsed[f].alias(f) for f in struct.fieldNames()]))
    return df.select("*", record.alias("record"), F.coalesce(whole, F.lit(False)).alias("valid"))


def validate_json_list(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Model output that should be a JSON array of records: a row per element with
    its place ``at``, its own text in ``raw``, ``record`` and ``valid``. Output that is
    null, empty, or no array is one row, not valid, with a null ``at``."""
    parts = F.from_json(F.col(raw), T.ArrayType(T.StringType()))
    others = [c for c in df.columns if c != raw]
    each = df.select(*others, F.posexplode_outer(F.when(F.ltrim(raw).startswith("["), parts)).alias("at", raw))
    return validate_json(each, raw, schema)
