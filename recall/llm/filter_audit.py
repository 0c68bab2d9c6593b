"""Filter interaction audit: what each filter removes at each step of every filter order, from decision diagrams.

One pass gives each document the set of filters that it fails (its mask), without any
order: the filters A to D look at the text alone, E (a copy of a smaller id's text) at
all texts. Documents are counted by (part, mask); everything else is read from these
counts, at most 32 a part, so no order is ever run over the documents.

A part's counts become a count-weighted decision diagram: one level per filter, a
node for each set of outcomes of the filters above it, with the number of documents
that have them (and how many of these are good, and toxic). The all-pass path from the root is the
run of one order: at each of its nodes the failing side's weight is what that
filter removes there. Another order is reached by swapping two adjacent levels, which rebuilds
only these two; orders are visited so that each is one swap from the one before.

Defined cases: a null text is empty (no words, no characters: it fails A only, and E if an
earlier empty text exists); a null part is the empty string; a null id is never smaller than another id and has
no smaller one, so it fails no E; repeated rows count each, and equal ids are not smaller than each other; a document is
good (toxic) if any of its labels says so; an empty table gives an empty result. Very long texts are read in blocks, in place; only the
distinct words of one text are held. Only ``doc_id``, ``text`` and the part's column are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import text_views, word_blocks, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(65, 91))
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that go on with a code point
SYMBOLS = re.compile(rb"[#$%&*|]")
BLOCK = 1 << 18


def text_mask(text: memoryview) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    n_words, distinct, capitals, points, symbols = 0, set(), 0, 0, False
    for words in word_blocks(text):
        n_words += len(words)
        distinct.update(words)
    for at in range(0, len(text), BLOCK):
        part = bytes(text[at:at + BLOCK])
        capitals += len(part) - len(part.translate(None, CAPITALS))
        points += len(part.translate(None, FOLLOWING))
        symbols = symbols or SYMBOLS.search(part) is not None
    fails = (n_words < 50, 100 * len(distinct) < 65 * n_words, 100 * capitals > 5 * points, symbols)
    return sum(1 << i for i, f in enumerate(fails) if f)


def text_masks(docs: DataFrame, part: str) -> DataFrame:
    """``part, doc_id, mask, digest`` of each document; the digest (SHA-256) stands for the whole text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(text_views(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text_mask(t) for t in texts], pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["part", "doc_id", "mask", "digest"])

    return docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "part string, doc_id long, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, docs, good, toxic``: documents by part and the set of filters that they fail.

    Copies are counted before they meet: rows of one text, part and id become one row, then
    those of one text and part, so a text that a third of all rows have costs few rows.
    """
    rows = written(text_masks(docs, part).groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("docs")), "audit-masks")
    marks = written(
        labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")).filter("good + toxic > 0"), "audit-labels")
    # Of a text's rows in a part: how many, how many without id, the smallest id and its rows.
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "docs")))
    texts = written(marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("docs").alias("docs"), F.sum(F.when(F.col("doc_id").isNull(), F.col("docs")).otherwise(0)).alias("no_id"),
        first.alias("first")), "audit-texts")
    lows = written(texts.groupBy("digest").agg(F.min("first.doc_id").alias("low"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "audit-lows")
    joined = texts.join(lows, "digest", "left")
    low = F.coalesce("low", "first.doc_id")
    earliest = F.col("no_id") + F.when(F.col("first.doc_id") == low, F.col("first.docs")).otherwise(0)
    both = joined.select(
        "part", "mask", "good", "toxic", F.explode(F.array(
            F.struct(F.lit(0).alias("copy"), earliest.alias("n")),
            F.struct(F.lit(COPY).alias("copy"), (F.col("docs") - earliest).alias("n")))).alias("side"))
    return both.filter("side.n > 0").groupBy("part", F.col("mask").bitwiseOR(F.col("side.copy")).alias("mask")).agg(
        F.sum("side.n").alias("docs"), F.sum(F.col("side.n") * F.col("good")).alias("good"),
        F.sum(F.col("side.n") * F.col("toxic")).alias("toxic"))


class Diagram:
    """A count-weighted decision diagram: ``levels[k]`` are the nodes that decide on ``order[k]``.

    A node is (weight, pass side, fail side); the last sides are leaves. Equal leaves are one, and so are nodes with equal sides.
    """

    def __init__(self, masks: dict[int, tuple[int, ...]], order: str):
        self.order = order
        self.unique: dict[tuple, tuple] = {}
        self.leaves: dict[tuple, tuple] = {}
        self.root = self.built(masks, 0, 0)

    def built(self, masks: dict[int, tuple[int, ...]], level: int, mask: int):
        if level == len(self.order):
            weight = masks.get(mask, (0, 0, 0))
            return self.leaves.setdefault(weight, (weight, None, None))
        bit = 1 << FILTERS.index(self.order[level])
        return self.node(self.built(masks, level + 1, mask), self.built(masks, level + 1, mask | bit))

    def node(self, passed: tuple, failed: tuple) -> tuple:
        weight = tuple(a + b for a, b in zip(passed[0], failed[0]))
        return self.unique.setdefault((id(passed), id(failed)), (weight, passed, failed))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below it; nodes above keep their weights."""
        def exchanged(node: tuple) -> tuple:
            _, (_, pp, pf), (_, fp, ff) = node
            return self.node(self.node(pp, fp), self.node(pf, ff))

        def rebuilt(node: tuple, depth: int) -> tuple:
            if depth == level:
                return exchanged(node)
            return self.node(rebuilt(node[1], depth + 1), rebuilt(node[2], depth + 1))

        self.root = rebuilt(self.root, 0)
        o = list(self.order)
        o[level], o[level + 1] = o[level + 1], o[level]
        self.order = "".join(o)

    def all_pass_path(self) -> list[tuple[tuple, tuple]]:
        """(weight that passes, weight that fails) at each step of the order."""
        steps, node = [], self.root
        while node[1] is not None:
            steps.append((node[1][0], node[2][0]))
            node = node[1]
        return steps


def swap_sequence(n: int) -> Iterator[int]:
    """Levels to swap with the one below, one after the other, to visit all orders of ``n`` levels once.

    The last item sweeps from end to end; between sweeps the others make their next swap.
    """
    if n < 2:
        return
    down, others = True, swap_sequence(n - 1)
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        inner = next(others, None)
        if inner is None:
            return
        yield inner + down
        down = not down


def part_steps(masks: dict[int, tuple[int, ...]]) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    failing = {f: sum(w[0] for m, w in masks.items() if m >> i & 1) for i, f in enumerate(FILTERS)}
    alone = {f: masks.get(1 << i, (0, 0, 0))[0] for i, f in enumerate(FILTERS)}
    total, rows = dict.fromkeys(FILTERS, 0), []
    diagram = Diagram(masks, FILTERS)

    def read() -> None:
        for k, (passed, failed) in enumerate(diagram.all_pass_path()):
            f = diagram.order[k]
            total[f] += failed[0]
            rows.append((diagram.order, k + 1, passed[0], failed[0], failing[f] - failed[0], alone[f], failed[1], failed[2], f))

    read()
    for level in swap_sequence(len(FILTERS)):
        diagram.swap(level)
        read()
    return [(*r[:-1], total[r[-1]]) for r in rows]


STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
         "toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: see ``STEPS``. A part is at most 32 counts in one task."""
    def steps(group: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): tuple(map(int, w)) for m, *w in zip(group["mask"], group["docs"], group["good"], group["toxic"])}
        out = pd.DataFrame(part_steps(masks), columns=[c.split(" ")[0] for c in STEPS.split(", ")[1:]])
        out.insert(0, "part", group["part"].iloc[0])
        return out

    return written(mask_counts(docs, labels, part), "audit-counts").groupBy("part").applyInPandas(steps, STEPS)
