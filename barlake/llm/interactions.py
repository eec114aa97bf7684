"""Filter interaction audit: what each order of the filters removes, read off count-weighted decision diagrams.

A document's failure mask has a bit per filter. The masks of a part are a decision diagram whose levels are filters and
whose leaves are counts; swapping adjacent levels leads from one order of the filters to the next, and along the path of
a diagram on which every filter passes lie the counts that its order keeps and removes at each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import SPACES

#: A document's filters: failures of the first four come from its text, E's from other documents with the same one.
FILTERS = "ABCDE"
Weight = tuple[int, ...]


class Diagram:
    """A reduced diagram: equal nodes are one. A node is (pass, fail), a leaf its counts; every path meets every level."""

    def __init__(self, masks: dict[int, Weight], order: str) -> None:
        self.order, self.width = list(order), len(next(iter(masks.values())))
        self.nodes: dict[tuple, int] = {}
        self.pairs: list[tuple] = []
        self.sums: list[Weight] = []
        bits = [1 << order.index(f) for f in order]

        def build(level: int, mask: int) -> int:
            if level == len(order):
                return self.leaf(masks.get(mask, (0,) * self.width))
            return self.node(build(level + 1, mask), build(level + 1, mask | bits[level]))

        self.root = build(0, 0)

    def add(self, key: tuple, weight: Weight) -> int:
        at = self.nodes.get(key)
        if at is None:
            at = self.nodes[key] = len(self.pairs)
            self.pairs.append(key)
            self.sums.append(weight)
        return at

    def leaf(self, weight: Weight) -> int:
        return self.add(("leaf", *weight), weight)

    def node(self, ok: int, bad: int) -> int:
        return self.add((ok, bad), tuple(a + b for a, b in zip(self.sums[ok], self.sums[bad])))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes above are linked anew, those below stay as they are."""
        done: dict[int, int] = {}

        def anew(at: int, depth: int) -> int:
            if at not in done:
                a, b = self.pairs[at]
                if depth < level:
                    done[at] = self.node(anew(a, depth + 1), anew(b, depth + 1))
                else:
                    (aa, ab), (ba, bb) = self.pairs[a], self.pairs[b]
                    done[at] = self.node(self.node(aa, ba), self.node(ab, bb))
            return done[at]

        self.root = anew(self.root, 0)
        o = self.order
        o[level], o[level + 1] = o[level + 1], o[level]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """(filter, kept, removed) along the path on which every filter passes."""
        at = self.root
        for f in self.order:
            at, bad = self.pairs[at]
            yield f, self.sums[at], self.sums[bad]


def swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after the other, lead through all orders of ``n`` filters: the last filter walks from end to
    end through each order of the others."""
    if n < 2:
        return
    down, inner = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at
        down = not down


def audit_part(masks: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and
    step from a part's counts (documents, good ones, toxic ones) by mask."""
    d = Diagram(masks, filters)
    seen: list[tuple[str, list]] = [("".join(d.order), list(d.steps()))]
    for level in swaps(len(filters)):
        d.swap(level)
        seen.append(("".join(d.order), list(d.steps())))
    fails = {steps[0][0]: steps[0][2][0] for _, steps in seen}
    alone = {steps[-1][0]: steps[-1][2][0] for _, steps in seen}
    share = dict.fromkeys(filters, 0)
    for _, steps in seen:
        for f, _, removed in steps:
            share[f] += removed[0]
    return [(name, i, kept[0], lost[0], fails[f] - lost[0], alone[f], lost[1], lost[2], share[f]) for name, steps in seen for i, (f, kept, lost) in enumerate(steps, 1)]


def _own_failures(text: Column) -> Column:
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    n = F.size(words)
    failed = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text), text.rlike("[#$%&*|]"))
    mask = F.lit(0)
    for i, c in enumerate(failed):
        mask = mask + F.when(c, 1 << i).otherwise(0)
    return mask


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents by part and failures, bits in the order of FILTERS.

    Copies are counted per text and part before they meet, so neither a part nor a group of copies is ever one task's:
    of a text's rows, those with its smallest id pass E. Texts are the same if their SHA-256 is."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _own_failures(text).cast("int").alias("own"), F.unhex(F.sha2(text, 256)).alias("same"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    no = F.lit(0)
    named = d.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    nameless = d.where("doc_id is null").withColumns({"good": no, "toxic": no})
    kind = ["part", "own", "good", "toxic"]
    rows = named.unionByName(nameless).groupBy("same", "doc_id", *kind).agg(F.count("*").alias("n"))
    texts = rows.groupBy("same", *kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("least").over(Window.partitionBy("same"))  # a row per part and kind of labels
    first = F.when(F.col("least") == F.col("least_of_all"), F.col("at_least")).otherwise(0) + F.col("nameless")
    both = texts.withColumn("least_of_all", least).select(*kind, F.explode(F.array(F.struct(F.lit(0).alias("e"), first.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - first).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.groupBy("part", (F.col("own") + F.col("x.e")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good_n"), F.sum(n * F.col("toxic")).alias("toxic_n")).where("n > 0")


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masks: DataFrame) -> DataFrame:
    """Every order's steps for each part of failure_masks(); a part comes with at most 32 rows, one for each mask."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = t.to_pydict()
        found = audit_part({m: w for m, *w in zip(rows["mask"], *[map(int, rows[c]) for c in ("n", "good_n", "toxic_n")])})
        cols = list(zip(*found))
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[x.split()[0] for x in OUT.split(", ")])

    return masks.groupBy("part").applyInArrow(run, OUT)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    A null text is empty, and fails A; a null source is the part of the empty string. Documents with a null id fail E never
    and make no other fail it; rows with the same id and text don't fail E for each other. A document is good or toxic if any
    of its labels says so. Very long texts are read whole, an empty table gives no rows, and columns of other names
    aren't looked at."""
    return audit(failure_masks(docs, labels))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"), common.table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
