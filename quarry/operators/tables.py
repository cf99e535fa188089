"""Exact answers over tables (C3): aggregates, lookups, profiles.

All aggregates are single ``agg`` passes (partial + final aggregation, one
shuffle). Row-order operators (preview, head/tail) use ``orderBy().limit()``
which Spark runs as a per-partition top-k followed by a merge, never a global
window over the table.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import exprs as X
from quarry.session import scratch_path

# Question words -> aggregate (first match wins, in this order).
OP_WORDS = [
    ("median", "median"),
    ("average", "avg"), ("avg", "avg"), ("mean", "avg"),
    ("maximum", "max"), ("max", "max"), ("highest", "max"), ("largest", "max"), ("most", "max"),
    ("minimum", "min"), ("min", "min"), ("lowest", "min"), ("smallest", "min"), ("least", "min"),
    ("total", "sum"), ("sum", "sum"), ("aggregate", "sum"),
    ("how many", "count"), ("number of", "count"), ("count", "count"),
]


MEDIAN_BITS = 14        # the value range is cut into 2^14 ranges at once
GRAM = 8                # J6: names meet by their first characters, at most so many


def _agg(op: str, c):
    c = F.col(c) if isinstance(c, str) else c
    return {"sum": F.sum(c), "count": F.count(c), "avg": F.avg(c), "max": F.max(c), "min": F.min(c)}[op]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: str, b: str, keys: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _values(df: DataFrame, value: str, *more) -> DataFrame:
    """``more`` and x: the value as a finite double; rows without a number are left out."""
    top, v = F.lit(sys.float_info.max), F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(*more, F.greatest(F.least(v, top), -top).alias("x"))


def _range_no(x, lo, hi, bits: int):
    """Which of 2^bits equal ranges from lo (0) to hi (2^bits - 1) holds x."""
    share = (x / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    last = (1 << bits) - 1
    return F.when(x == lo, 0).when(x == hi, last).otherwise(F.floor(share * last)).cast("int")


def exact_median(df: DataFrame, keys: list[str], value: str, bits: int = MEDIAN_BITS) -> DataFrame:
    """(keys, median): exact medians by counts, so that no task ever holds a
    group's values. The values are counted in equal ranges between a group's least
    and greatest value (at most 2^bits rows a group leave a task); the range that
    holds the middle, narrowed to the least and greatest value in it, is counted
    again until it is one value. Each round keeps one or two rows a group.

    NULL and not-a-number are left out; infinities count as the largest finite
    numbers. A group without a value, or an empty table, has no row."""
    ks = [f"_k{i}" for i in range(len(keys))]
    if not keys:
        m = column_median(df, value, bits)
        return df.sparkSession.createDataFrame([] if m is None else [(m,)], "median double")
    data = _values(df, value, *[F.col(k).alias(a) for k, a in zip(keys, ks)])
    state = _written(data.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                     .select(*ks, F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))).alias("rank"),
                             "lo", "hi"), "median")
    x, lo, hi = F.col("d.x"), F.col("i.lo"), F.col("i.hi")
    while state.where("lo < hi").limit(1).count():
        ranges = state.where("lo < hi").select(*ks, "lo", "hi").distinct().alias("i")
        found = data.alias("d").join(ranges, _same("d", "i", ks) & (x >= lo) & (x <= hi)) \
            .groupBy(*[f"i.{k}" for k in ks], "i.lo", "i.hi", _range_no(x, lo, hi, bits).alias("b")) \
            .agg(F.count(F.lit(1)).alias("c"), F.min("d.x").alias("least"), F.max("d.x").alias("most")) \
            .withColumn("upto", F.sum("c").over(Window.partitionBy(*ks, "lo", "hi").orderBy("b"))).alias("f")
        s = state.alias("s")
        moved = s.join(found, _same("s", "f", [*ks, "lo", "hi"]) & (F.col("s.rank") < F.col("f.upto")) & (
            F.col("s.rank") >= F.col("f.upto") - F.col("f.c")))
        state = _written(moved.select(*[f"s.{k}" for k in ks], (F.col("s.rank") - F.col("f.upto") + F.col("f.c")).alias("rank"),
                                      F.col("f.least").alias("lo"), F.col("f.most").alias("hi"))
                         .unionByName(state.where("lo = hi")), "median")
    out = state.groupBy(*ks).agg((F.min("lo") * 0.5 + F.max("lo") * 0.5).alias("median"))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "median")


def column_median(df: DataFrame, value: str, bits: int = MEDIAN_BITS) -> float | None:
    """``exact_median`` of a whole column. The ranges are literals, which reach
    the scan as filters; a round brings back the two ranges of the middle."""
    data = _values(df, value)
    n, lo, hi = data.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    middle = [(rank, lo, hi) for rank in ((n - 1) // 2, n // 2)]
    while any(a < b for _r, a, b in middle):
        for a, b in {(a, b) for _r, a, b in middle if a < b}:
            inside = data.where((F.col("x") >= a) & (F.col("x") <= b))
            counts = inside.groupBy(_range_no(F.col("x"), F.lit(a), F.lit(b), bits).alias("b")).agg(
                F.count("x").alias("c"), F.min("x").alias("least"), F.max("x").alias("most")) \
                .withColumn("before", F.sum("c").over(Window.orderBy("b")) - F.col("c"))
            ranks = [r for r, *ab in middle if ab == [a, b]]
            hit = counts.where(reduce(lambda p, q: p | q, [
                (F.col("before") <= r) & (F.col("before") + F.col("c") > r) for r in ranks])).collect()
            middle = [m if [m[1], m[2]] != [a, b] else next((m[0] - h.before, h.least, h.most) for h in hit
                                                            if h.before <= m[0] < h.before + h.c) for m in middle]
    return 0.5 * middle[0][1] + 0.5 * middle[1][1]


def agg_scalar(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """A1: total, count, average, median, maximum, minimum of one column."""
    c = F.col(col)
    return df.agg(F.round(F.sum(c), digits).alias("total"), F.count(c).alias("n"),
                  F.round(F.avg(c), digits).alias("average"),
                  F.round(F.lit(column_median(df, col)).cast("double"), digits).alias("median"),
                  F.round(F.max(c), digits).alias("maximum"), F.round(F.min(c), digits).alias("minimum"))


def agg_labeled(df: DataFrame, specs: list[tuple[str, str, str]], digits: int = 2) -> DataFrame:
    """A2: several (label, op, column) values from one aggregation, returned
    as (label, value) rows; medians are found by counts beforehand."""
    medians = {c: column_median(df, c) for _l, op, c in specs if op == "median"}
    row = df.agg(*[F.round(F.lit(medians[c]).cast("double") if op == "median" else _agg(op, c).cast("double"), digits)
                             .alias(f"v{i}") for i, (_l, op, c) in enumerate(specs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"v{i}").alias("value"))
                                          for i, (lab, _o, _c) in enumerate(specs)])).alias("r")).select("r.*")


def filter_count(df: DataFrame, col: str, needle: str, value_col: str | None = None,
                 digits: int = 2) -> DataFrame:
    """A3: case-insensitive ``contains`` filter, then count (and sum)."""
    hit = F.coalesce(F.lower(F.col(col).cast("string")).contains(needle.lower()), F.lit(False))
    aggs = [F.count_if(hit).alias("n")]
    if value_col:
        aggs.append(F.round(F.sum(F.when(hit, F.col(value_col))), digits).alias("total"))
    return df.agg(*aggs)


def any_column_search_count(df: DataFrame, needle: str, cols: list[str] | None = None) -> DataFrame:
    """Rows where any column's text contains ``needle`` (case-insensitive)."""
    cols = cols or df.columns
    arr = F.array(*[F.col(c).cast("string") for c in cols])
    hit = F.exists(arr, lambda v: F.coalesce(F.lower(v).contains(needle.lower()), F.lit(False)))
    return df.agg(F.count_if(hit).alias("n"))


def subtotals(df: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """A4: rollup subtotals and grand total with ``grouping_id``."""
    return (df.rollup(*keys).agg(F.round(F.sum(value), digits).alias("total"),
                                 F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")))


def extreme_row(df: DataFrame, by: list[str], value: str, ids: list[str]) -> DataFrame:
    """A5: highest and lowest row per group (ties: smallest ids), for values and
    ids of any orderable type: the smallest ids of each value, then the rows of
    the extreme values. Both aggregations combine on the map side."""
    least = df.groupBy(*by, value).agg(F.min(F.struct(*ids)).alias("_ids"))
    keep = F.struct(*[F.col(f"_ids.{c}").alias(c) for c in ids], F.col(value))
    agg = least.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.max_by(keep, F.col(value)).alias("hi"), F.min_by(keep, F.col(value)).alias("lo"))
    hi = agg.select(*by, F.lit("highest").alias("kind"), "hi.*")
    lo = agg.select(*by, F.lit("lowest").alias("kind"), "lo.*")
    return hi.unionByName(lo)


def result_preview(df: DataFrame, order: list[str], n: int = 30) -> DataFrame:
    """T4: first ``n`` rows of a result in key order (top-k, not a sort of
    the whole table into one partition)."""
    return df.orderBy(*order).limit(n)


def head_tail(df: DataFrame, order: list[str], head: int = 4, tail: int = 3) -> DataFrame:
    """T5: first ``head`` and last ``tail`` rows by ``order`` (which tells rows
    apart); a row of a short table that is in both counts as head."""
    h = df.orderBy(*[F.col(c).asc() for c in order]).limit(head).withColumn("part", F.lit("head"))
    t = df.orderBy(*[F.col(c).desc() for c in order]).limit(tail).withColumn("part", F.lit("tail"))
    return h.unionByName(t.join(h.select(*order), order, "left_anti").select(*h.columns))


def column_profile(df: DataFrame, name: str, max_cols: int = 30, approx: bool = False) -> DataFrame:
    """Per column (first ``max_cols``): type, non-null count, distinct
    count, numeric min/max. One unpivot + one grouped aggregation; with
    ``approx`` the distinct count is a HyperLogLog sketch (no per-value
    shuffle), which is what a profile of a very large table should use."""
    fields = df.schema.fields[:max_cols]
    numeric = (T.NumericType,)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f.name).cast("string").alias("s"),
                 (F.col(f.name).cast("double") if isinstance(f.dataType, numeric)
                  else F.lit(None).cast("double")).alias("x"))
        for i, f in enumerate(fields)])).alias("c")).select("c.*")
    return (long.groupBy("ord", "column", "type")
            .agg(F.count("s").alias("n_non_null"),
                 (F.approx_count_distinct("s") if approx else F.countDistinct("s")).alias("n_distinct"),
                 F.min("x").alias("min_num"), F.max("x").alias("max_num"))
            .withColumn("table", F.lit(name)))


def table_summary(df: DataFrame, name: str, max_cols: int = 30) -> DataFrame:
    """A13 header line: name, row count, first ``max_cols`` ``name:type``."""
    cols = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields[:max_cols])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table"), "n_rows", F.lit(cols).alias("columns"))


def question_spec(questions: DataFrame, text: str = "question") -> DataFrame:
    """P10 -> spec: the aggregate named first in the question (OP_WORDS order)."""
    q = F.lower(F.col(text))
    op = F.lit(None).cast("string")
    for word, o in reversed(OP_WORDS):
        op = F.when(q.rlike(r"\b" + word.replace(" ", r"\s+") + r"\b"), F.lit(o)).otherwise(op)
    return questions.withColumn("op", op)


def answer_specs(table: DataFrame, specs: DataFrame, key: str, value: str, table_name: str,
                 label: str, digits: int = 2) -> DataFrame:
    """Exact results for many (qid, op, key value) specs in one pass.

    The table is first reduced to one row per key with every supported
    aggregate (partial aggregation; the table is scanned once however many
    questions there are, but for the rounds that find the medians), then the
    specs join that small result. The number is rendered (F1), phrased (F5) and
    audited (F3)."""
    per_key = table.groupBy(key).agg(*[_agg(o, value).cast("double").alias(o) for o in ("sum", "count", "avg", "max", "min")])
    per_key = per_key.join(exact_median(table, [key], value), key, "left")
    j = specs.join(per_key, specs["filter_val"] == per_key[key], "left")
    v = F.round(F.coalesce(*[F.when(F.col("op") == o, F.col(o)) for o in
                              ("sum", "count", "avg", "median", "max", "min")]), digits)
    out = j.select("qid", "op", "filter_val", v.alias("value"))
    pair = F.concat(F.col("op"), F.lit(" "), F.lit(label), F.lit(": "), X.fmt_num(F.col("value")))
    text = F.concat(F.lit(f"According to {table_name}, "), pair, F.lit("."))
    out = out.withColumn("answer", F.when(F.col("value").isNotNull(), text))
    return out.withColumn("verified", F.coalesce(
        X.verify_numbers(F.col("answer"), F.array(F.col("value"))), F.lit(False)))


def _starts(names: DataFrame, col: str, gram: int) -> DataFrame:
    """(name columns, key): the first ``gram`` characters, or fewer if the name has fewer."""
    return names.withColumn("key", F.substring(F.lower(col), 1, gram))


def _parts(names: DataFrame, col: str, gram: int) -> DataFrame:
    """(name columns, key): every different stretch of at most ``gram`` characters."""
    low = F.lower(col)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(gram)), lambda n: F.substr(low, i, n.cast("int"))))
    return names.withColumn("key", F.explode(F.array_distinct(F.flatten(cuts))))


def resolve_table_name(requests: DataFrame, catalog: DataFrame, gram: int = GRAM) -> DataFrame:
    """Exact name, else case-insensitive substring either way; first in
    catalogue (load) order. A name that lies in another starts with one of the
    other's stretches, so candidates meet in an equi-join on at most ``gram``
    characters and are then checked whole; neither side is broadcast by force."""
    r, c = requests.select("request").distinct(), catalog.select("name", "ordinal")
    found = _starts(r, "request", gram).join(_parts(c, "name", gram), "key").where(F.lower("name").contains(F.lower("request"))) \
        .unionByName(_parts(r, "request", gram).join(_starts(c, "name", gram), "key")
                     .where(F.lower("request").contains(F.lower("name"))))
    exact = (F.col("request") == F.col("name")).cast("int")
    best = found.groupBy("request").agg(F.min_by(F.col("name"), F.struct(-exact, F.col("ordinal"))).alias("resolved")).alias("b")
    return r.alias("r").join(best, F.col("r.request") == F.col("b.request"), "left").select("r.request", "b.resolved")
