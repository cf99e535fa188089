"""Filter interaction audit: what every order of a set of filters removes, by part.

A document's failures are a mask with one bit a filter. All that any order can
remove follows from the counts of the masks, so the texts are read once; only
(part, mask, labels, count) goes on. For each part a count-weighted decision
diagram is built over its masks: a level per filter, the low edge for passing,
the high edge for failing, equal parts of the diagram shared, and each node
weighted by the documents below it. Neighbouring levels are swapped in place
until every order has been on top once; the path of low edges of an order (all
filters passed) gives its steps: the weight of a node's high edge is what the
filter removes there, that of its low edge what it keeps.

Scale: the texts are read in their scan tasks, and 60 bytes a document are
written as a table. Repeated rows are counted together before any join; the
least id of a text is found among its few (part, label) sums, and both sides of
the label join are written first, so AQE can deal out a hot id. A part's diagram has at most 2^filters masks, whatever the
number of documents.

Defined results: a null text is empty; a null part is the empty string (and
joins documents whose part is empty); a null id fails no duplicate filter and
is nobody's duplicate; rows that repeat an id with its text count each, and so
fail together or not at all; labels are 1 or not (null: not, several rows of an
id: any). A very long text takes memory for its own words only. An empty table
gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"

Rule = Callable[[bytes, list], bool]


def few_words(text: bytes, words: list) -> bool:
    return len(words) < 200


def few_distinct_words(text: bytes, words: list) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(text: bytes, words: list) -> bool:
    capitals = len(text) - len(text.translate(None, UPPER))
    return capitals > 0 and 100 * capitals > 3 * len(text.decode())


def holds_symbols(text: bytes, words: list) -> bool:
    return len(text.translate(None, SYMBOLS)) < len(text)


#: Rules on one text, by letter: (UTF-8 text, its words) -> fails.
RULES: dict[str, Rule] = {"A": few_words, "B": few_distinct_words, "C": many_capitals, "D": holds_symbols}
#: The filter that needs the whole table: a text that a smaller id has as well.
DUPLICATE = "E"


def text_failures(docs: DataFrame, rules: dict[str, Rule], part_col: str) -> DataFrame:
    """(doc_id, part, digest, mask): bit k of the mask is set if rule k fails."""
    tests = list(rules.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, masks = [], []
            for value in b.column(2):
                text = (value.as_py() or "").encode()
                words = text.split()
                digests.append(hashlib.sha256(text).digest())
                masks.append(sum(test(text, words) << k for k, test in enumerate(tests)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                  ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each failure mask, the
    duplicate filter as the bit after the rules'."""
    seen = stage(text_failures(docs, rules, part_col), "audit-failures")
    rows = seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = stage(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_q"), F.max((F.col("toxic") == 1).cast("int")).alias("_t")), "audit-labels")
    mark = [F.coalesce(c, F.lit(0)).alias(a) for c, a in ((F.col("_q"), "good"), (F.col("_t"), "toxic"))]
    known = stage(rows.where("doc_id is not null"), "audit-rows").join(marks, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "digest", "part", "mask", "n", *mark)
    unknown = rows.where("doc_id is null").select("doc_id", "digest", "part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    # one row for each text, part and label: its documents, those under its least id, and the ones without an id
    keys = ["digest", "part", "mask", "good", "toxic"]
    texts = known.unionByName(unknown).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    # a text has at most four rows a part here, however many documents have it
    texts = texts.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    stays = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = texts.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), stays.alias("n")),
        F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), (F.col("n") - stays).alias("n")))).alias("s"))
    return split.select("part", "s.mask", "s.n", "good", "toxic").where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class Diagram:
    """Ordered decision diagram over failure masks. A node of level i is a pair
    (low, high) of nodes of level i + 1; below the last level lie leaves, one
    for each different weight. Every node stands in the table of its level once
    (equal sub-diagrams are shared) and carries its weight: the sum of the
    leaves under it, counted along every path."""

    def __init__(self, order: str, counts: dict[int, tuple]):
        self.order = list(order)
        n = len(order)
        self.levels: list[dict] = [{} for _ in range(n)]  # (low, high) -> node
        self.nodes: dict[int, tuple] = {}  # node -> (low, high)
        self.weight: dict[int, np.ndarray] = {}
        self.leaves: dict[tuple, int] = {}
        zero = tuple([0] * len(next(iter(counts.values()))))
        row = [self.leaf(counts.get(sum(((m >> (n - 1 - k)) & 1) << k for k in range(n)), zero)) for m in range(1 << n)]
        for level in reversed(range(n)):
            row = [self.node(level, row[k], row[k + 1]) for k in range(0, len(row), 2)]
        self.root = row[0]

    def leaf(self, weight: tuple) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = at = len(self.weight)
            self.weight[at] = np.array(weight, object)  # Python integers: never overflow
        return self.leaves[weight]

    def node(self, level: int, low: int, high: int) -> int:
        found = self.levels[level].get((low, high))
        if found is None:
            found = self.levels[level][low, high] = len(self.weight)
            self.nodes[found] = (low, high)
            self.weight[found] = self.weight[low] + self.weight[high]
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next: only the nodes of
        these two levels are made anew, what lies above keeps its shape and
        what lies below is untouched."""
        upper, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        moved = {}
        for (low, high), at in upper.items():
            (ll, lh), (hl, hh) = self.nodes[low], self.nodes[high]
            moved[at] = self.node(level, self.node(level + 1, ll, hl), self.node(level + 1, lh, hh))
        for above in reversed(range(level)):  # parents point at the new nodes
            old, self.levels[above] = self.levels[above], {}
            moved = {at: self.node(above, moved[low], moved[high]) for (low, high), at in old.items()}
        self.root = moved[self.root]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.forget()

    def forget(self) -> None:
        """Drop nodes that no level holds any more."""
        live = {at for table in self.levels for at in table.values()}
        self.nodes = {at: kids for at, kids in self.nodes.items() if at in live}

    def steps(self) -> list[tuple]:
        """(kept, removed) weights along the path of low edges."""
        out, at = [], self.root
        for _ in self.order:
            low, high = self.nodes[at]
            out.append((self.weight[low], self.weight[high]))
            at = low
        return out

    def only(self, level: int) -> np.ndarray:
        """Weight of the path that fails the filter of ``level`` and no other."""
        at = self.root
        for k in range(len(self.order)):
            at = self.nodes[at][k == level]
        return self.weight[at]


def swaps(n: int) -> Iterator[int]:
    """Neighbouring exchanges that lead through all orders of n things, each
    once: the last of them walks through every order of the others."""
    if n < 2:
        return
    rest, down = list(swaps(n - 1)), True
    for k in range(len(rest) + 1):
        yield from reversed(range(n - 1)) if down else range(n - 1)
        if k < len(rest):
            yield rest[k] + down
        down = not down


def audit_part(part: str, counts: dict[int, tuple], names: str) -> list[tuple]:
    """Rows of one part, for every order and step; ``counts``: mask -> (n, good, toxic)."""
    diagram = Diagram(names, counts)
    n = len(names)
    fails = {f: sum(c[0] for m, c in counts.items() if m >> k & 1) for k, f in enumerate(names)}
    unique = {f: diagram.only(k)[0] for k, f in enumerate(names)}
    shapley = dict.fromkeys(names, 0)
    rows = []
    moves = swaps(n)
    while True:
        for step, (f, (kept, removed)) in enumerate(zip(diagram.order, diagram.steps()), 1):
            shapley[f] += removed[0]
            rows.append((part, "".join(diagram.order), step, kept[0], removed[0], fails[f] - removed[0], unique[f], removed[1], removed[2], f))
        level = next(moves, None)
        if level is None:
            return [(*r[:-1], shapley[r[-1]]) for r in rows]
        diagram.swap(level)


AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def audit_orders(counts: DataFrame, names: str) -> DataFrame:
    """Every order and step of the filters ``names`` (one letter each, bit by
    bit) from (part, mask, n, good, toxic); a part is one small group."""
    columns = [c.split()[0] for c in AUDIT.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(a), int(g), int(t)) for m, a, g, t in zip(group["mask"], group["n"], group["good"], group["toxic"])}
        return pd.DataFrame(audit_part(group["part"].iloc[0], found, names), columns=columns)
    return counts.groupBy("part").applyInPandas(run, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES, part_col: str = "lang") -> DataFrame:
    """The audit of ``rules`` and the duplicate filter, by ``part_col``."""
    return audit_orders(mask_counts(docs, labels, rules, part_col), "".join(rules) + DUPLICATE)
