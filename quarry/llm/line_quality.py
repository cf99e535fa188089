"""Quality rules from line frequencies across documents.

Lines are normalised and hashed; for each host the number of distinct documents
that hold a line is counted; lines above the host's limit are removed, and a
document that loses too much is rejected as depleted. Built-in functions only.

Defined results: a null text has no words and is rejected by the base rules;
a null host is a host of its own; documents with the same text on one host count
as one document, so copies do not turn each other's lines into boilerplate; rows
that repeat a document share its verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, let, words_col

MIN_WORDS = 10          # fewer words fail the base rules
MAX_REPEAT_PCT = 20     # so many words in repeated windows fail them too
WINDOW = 5
MIN_DOCS = 20           # a line in at most so many documents of a host always stays
MAX_SHARE = 0.1         # ... and one in at most this share of the host's documents
MIN_LEFT = 0.3          # a document with a smaller share of its characters left is depleted

SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, each run of other characters as one blank."""
    line = F.regexp_replace(F.lower(line), r"\p{N}", "0")
    return F.trim(F.regexp_replace(line, r"[^\p{L}0]+", " "))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur at least twice.

    The windows' hashes are sorted only in texts that repeat one; neighbours in
    that order give the repeated starts, whose union is summed up in one pass."""
    def starts(g):
        ranked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def pick(s):
            def same(x, j):
                return ((F.get(s, j - 1)["h"] == x["h"]) & (j > 0)) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        return let(ranked, pick)

    def covered(p):
        init = F.struct(F.lit(-width).cast("int").alias("at"), F.lit(0).cast("int").alias("n"))
        step = F.aggregate(p, init, lambda a, x: F.struct(
            x.cast("int").alias("at"), (a["n"] + F.least(F.lit(width), x - a["at"])).cast("int").alias("n")))
        return step["n"]

    def grams(h):
        return F.when(F.size(h) < width + 1, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - width),
                        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashed, grams), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0))
               .otherwise(let(starts(g), covered))).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the statistics of its text alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", F.xxhash64("t").alias("t_hash"), F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("t")).alias("n_dup_lines"),
        let(words_col(F.col("t")), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_words(w).alias("rep"))).alias("w"))
    return out.select(
        "doc_id", "t_hash", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols",
        "n_dup_lines", F.col("w.rep").alias("n_repeat_words"),
        ((F.col("w.n") < MIN_WORDS) | (F.lit(100) * F.col("w.rep") > F.lit(MAX_REPEAT_PCT) * F.col("w.n")))
        .alias("base_failed"))


def document_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, t_hash, host, line, chars): one row per distinct normalised
    line of a document, with the characters of its normalised form times its
    number of occurrences."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n"), normal_line), lambda x: x != "")
    d = d.select("doc_id", "host", F.xxhash64("t").alias("t_hash"), F.explode(F.transform(
        lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.char_length(x).alias("chars")))).alias("x"))
    return (d.groupBy("doc_id", "t_hash", "host", "x.line").agg(F.sum("x.chars").alias("chars")))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, line_docs) of the lines above their host's limit."""
    docs = lines.select("host", "t_hash", "line").distinct()
    per_line = docs.groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs"))
    per_host = lines.select("host", "t_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    a, b = per_line.where(F.col("line_docs") > min_docs).alias("a"), per_host.alias("b")
    return (a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")))
            .where(F.col("line_docs") > F.col("host_docs") * F.lit(max_share))
            .select("a.host", "line", "line_docs"))


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The base statistics of each row of ``docs`` plus n_removed_lines (distinct
    lines above a limit), removed_share (of the characters of all its
    normalised lines) and kept.

    The lines of a document are combined in its task before anything moves; only
    hashes move. The join with the frequent lines is an inner equi-join, which
    AQE splits where a line is held by very many documents."""
    lines = document_lines(docs, id_col, text_col, host_col)
    bad = frequent_lines(lines, min_docs, max_share).alias("f")
    hit = lines.alias("l").join(bad, F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")))
    # summed over rows that repeat a document on both sides: the share stays the same
    hit = hit.groupBy("l.doc_id", "l.t_hash").agg(
        F.count_distinct(F.col("l.line")).alias("n_removed_lines"), F.sum("l.chars").alias("gone"))
    total = lines.groupBy("doc_id", "t_hash").agg(F.sum("chars").alias("all_chars"))
    h, t = hit.alias("h"), total.alias("t")
    both = t.join(h, F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t.t_hash") == F.col("h.t_hash"))).select(
        "t.doc_id", "t.t_hash", "n_removed_lines", (F.col("gone") / F.col("all_chars")).alias("removed_share")).alias("r")
    b = base_rules(docs, id_col, text_col).alias("b")
    out = b.join(both, F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.t_hash") == F.col("r.t_hash")), "left")
    share = F.coalesce("removed_share", F.lit(0.0))
    return out.select("b.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
                      share.alias("removed_share"),
                      (~F.col("base_failed") & (F.lit(1.0) - share >= F.lit(min_left))).alias("kept"))


def cleaned_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(doc_id, text) without the lines above their host's limit, in their old
    order. A document's frequent lines are gathered as hashes, at most as many
    as it has lines."""
    lines = document_lines(docs, id_col, text_col, host_col)
    bad = frequent_lines(lines, min_docs, max_share).alias("f")
    hit = (lines.alias("l").join(bad, F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")))
           .groupBy("l.doc_id", "l.t_hash").agg(F.collect_set("l.line").alias("gone")).alias("h"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"),
                    F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("t_hash")).alias("d")
    j = d.join(hit, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.t_hash") == F.col("h.t_hash")), "left")
    left = F.filter(F.split("t", "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(normal_line(x))))
    return j.select("d.doc_id", F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(left, "\n")).alias("text"))
