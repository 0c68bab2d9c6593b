"""Phrase collocations from truncated suffix trees, built by groups of word prefixes (vertical partitioning).

Every word position starts a suffix: its word and the words after it in the same
piece, up to the longest phrase. A phrase's occurrences are the suffixes that begin with it, so a node
of the suffix tree, cut off at that depth, counts its phrase by the totals of the leaves below it.

The tree is not built whole. Word prefixes are counted first; a prefix with more suffixes than a
group's memory budget is made longer by a word, until it fits or is as long as a
phrase. Then each prefix belongs to one of so many groups that each has about
half the budget, and the suffixes of a group make subtrees that no other group needs.
Map tasks count equal suffixes, number the words locally and send each group one
compressed block; a group's task renumbers the words, sorts the suffixes and reads all nodes'
counts from runs of equal prefixes. The counts of a phrase's first parts are those of the node's ancestors;
those of its last parts are other nodes, often in another group, and are joined.

Defined cases: a null text is empty, a null language is ``und``; a language without candidates has no rows; ties are
broken down to the phrase itself; repeated rows count each; an empty table gives an empty result. Long texts
are read in blocks, in place; only ``lang`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.rows import text_views, written

BREAK = b"\n"
#: A-Z in lower case, tab as space, and everything that ends a piece as BREAK.
CLEAN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n")
BLOCK = 1 << 18
TOKENS_AT_ONCE = 1 << 20
BUDGET = 1 << 20      # suffixes whose subtrees one task builds at once
MOST_HEAVY = 1 << 16  # prefixes over the budget, at most (the budget grows with the input beyond 2**36 words)


class Ids(dict):
    """Numbers of words in order of appearance; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def clean_blocks(text: memoryview) -> Iterator[bytes]:
    """The text through ``CLEAN``, cut only after whole words, with a break at its end."""
    begun: list[bytes] = []
    for at in range(0, len(text), BLOCK):
        part = bytes(text[at:at + BLOCK]).translate(CLEAN)
        cut = max(part.rfind(b" "), part.rfind(BREAK)) + 1
        if cut:
            yield b"".join([*begun, part[:cut]])
            begun = []
        begun.append(part[cut:])
    yield b"".join([*begun, BREAK])


def runs_of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words by number, numbers of the tokens) of some ``TOKENS_AT_ONCE`` tokens at a time."""
    held: dict[str, tuple[Ids, list[np.ndarray]]] = {}
    size = 0

    def flushed():
        for lang, (ids, parts) in held.items():
            yield lang, list(ids), np.concatenate(parts)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), text_views(batch.column(1))):
            for block in clean_blocks(text):
                ids, parts = held.setdefault(lang, (Ids(), []))
                tokens = TOKEN.findall(block)
                parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
                if size >= TOKENS_AT_ONCE and block.endswith(BREAK):
                    yield from flushed()
                    size = 0
    yield from flushed()


def suffixes(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """Columns of the suffixes' words, 0 beyond the end of the piece."""
    columns = [ids]
    for d in range(1, depth):
        following = np.zeros_like(ids)
        following[:-d] = ids[d:]
        columns.append(np.where(columns[-1] == 0, 0, following))
    starts = ids != 0
    return [c[starts] for c in columns]


def tallied(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, sorted, and the sum of ``n`` (or the number of rows) of each."""
    if columns[0].size == 0:
        return columns, np.empty(0, np.int64)
    width = max(int(c.max()) for c in columns).bit_length()
    if width * len(columns) <= 63:
        key = np.zeros(columns[0].size, np.int64)
        for c in columns:
            key = key << width | c
        if n is None:
            key, n = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[starts], np.add.reduceat(n[order], starts)
        shifts = range(width * (len(columns) - 1), -1, -width)
        return [(key >> s & ((1 << width) - 1)).astype(np.int32) for s in shifts], n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.r_[True, changes(columns)])
    n = np.ones(order.size, np.int64) if n is None else n[order]
    return [c[starts] for c in columns], np.add.reduceat(n, starts)


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])


def joined(words: list[bytes], columns: list[np.ndarray]) -> pa.Array:
    texts = pa.array(words, pa.binary())
    return pc.binary_join_element_wise(*[texts.take(pa.array(c)) for c in columns], b" ").cast(pa.string())


Heavy = list[dict[str, set[tuple[bytes, ...]]]]


def is_heavy(heavy: Heavy, lang: str, words: list[bytes] | dict, columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row's prefix (all ``columns``) is over the budget."""
    depth = len(columns)
    prefixes = heavy[depth - 1].get(lang, ()) if depth <= len(heavy) else ()
    out = np.zeros(columns[0].size, bool)
    if not prefixes:
        return out
    number = words if isinstance(words, dict) else {w: i for i, w in enumerate(words)}
    for first in {p[0] for p in prefixes}:
        rows = np.flatnonzero(columns[0] == number.get(first, -1))
        if depth == 1:
            out[rows] = True
            continue
        rest = {tuple(number.get(w, -1) for w in p[1:]) for p in prefixes if p[0] == first}
        found = zip(*[columns[d][rows].tolist() for d in range(1, depth)])
        out[rows] = np.fromiter((r in rest for r in found), bool, rows.size)
    return out


def prefix_counts(texts: DataFrame, depth: int, heavy: Heavy) -> DataFrame:
    """``lang, prefix, f`` of the prefixes of ``depth`` words whose first words are over the budget."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in runs_of_tokens(batches):
            columns = suffixes(ids, depth)
            wanted = columns[-1] != 0
            if depth > 1:
                wanted &= is_heavy(heavy, lang, words, columns[:-1])
            columns, n = tallied([c[wanted] for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n.size, pa.string()), joined(words, columns), pa.array(n, pa.int64())],
                                             names=["lang", "prefix", "f"])

    return texts.mapInArrow(rows, "lang string, prefix string, f long").groupBy("lang", "prefix").agg(F.sum("f").alias("f"))


def heavy_prefixes(texts: DataFrame, most_words: int, budget: int) -> tuple[DataFrame, Heavy, dict, int]:
    """(counts of all words, prefixes over the budget by length, their counts, budget).

    The counts of a longer prefix need another pass, made only if there are prefixes to lengthen. There are at most
    ``MOST_HEAVY`` of a length, as the budget is at least that part of all words.
    """
    words = written(prefix_counts(texts, 1, []), "word-counts")
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, -(-total // MOST_HEAVY))
    heavy: Heavy = []
    known: dict[tuple[str, tuple[bytes, ...]], int] = {}
    counts = words
    for depth in range(1, most_words):
        over = [(r["lang"], tuple(r["prefix"].encode().split(b" ")), r["f"]) for r in counts.filter(F.col("f") > budget).collect()]
        if not over:
            break
        heavy.append({})
        for lang, prefix, f in over:
            heavy[-1].setdefault(lang, set()).add(prefix)
            known[(lang, prefix)] = f
        if depth + 1 < most_words:
            counts = prefix_counts(texts, depth + 1, heavy)
    return words, heavy, known, budget


def blocks_of_groups(texts: DataFrame, most_words: int, heavy: Heavy, groups: int) -> DataFrame:
    """``group, lang, words, ids, n``: distinct suffixes and their counts, one block per group and run of tokens."""
    def packed(data: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(data)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in runs_of_tokens(batches):
            columns, n = tallied(suffixes(ids, most_words))
            if not n.size:
                continue
            word_hash = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            mixed = np.full(n.size, xxhash.xxh64_intdigest(lang), np.uint64)
            longer = np.ones(n.size, bool)  # the prefix takes in one more word
            for d in range(most_words):
                mixed = np.where(longer, (mixed ^ word_hash[columns[d]]) * np.uint64(0x9E3779B97F4A7C15), mixed)
                mixed ^= mixed >> np.uint64(29)
                if d + 1 > len(heavy):
                    break
                longer &= is_heavy(heavy, lang, words, columns[:d + 1])
            group = (mixed >> np.uint64(8)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            group, n, columns = group[order], n[order], [c[order] for c in columns]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n.size]):
                used, local = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
                out.append((int(group[a]), lang, packed(b" ".join(words[i] for i in used.tolist())),
                            packed(local.astype("<i4").tobytes()), packed(n[a:b].astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["group", "lang", "words", "ids", "n"])

    return texts.mapInArrow(rows, "group int, lang string, words binary, ids binary, n binary")


class Subtrees:
    """The suffixes of one group and language, added block by block."""

    def __init__(self, depth: int):
        self.depth, self.ids, self.columns, self.n = depth, Ids(), [[] for _ in range(depth)], []

    def add(self, words: bytes, ids: bytes, n: bytes) -> None:
        unpacked = zstandard.ZstdDecompressor().decompress
        own = np.array([self.ids[w] for w in unpacked(words).split(b" ")], np.int32)
        columns = own[np.frombuffer(unpacked(ids), "<i4")].reshape(self.depth, -1)
        for kept, c in zip(self.columns, columns):
            kept.append(c)
        self.n.append(np.frombuffer(unpacked(n), "<i8"))

    def nodes(self, lang: str, heavy: Heavy, known: dict, least: int) -> Iterator[pa.RecordBatch]:
        """Every node of ``least`` occurrences or more, with its ancestors' counts.

        A node above its prefix has leaves in other groups too: it is no row here, and its count is the known one.
        """
        columns, n = tallied([np.concatenate(c) for c in self.columns], np.concatenate(self.n))
        words = list(self.ids)
        above: list[np.ndarray] = []  # counts of the ancestors of each suffix, by depth
        for d in range(1, self.depth + 1):
            starts = np.flatnonzero(np.r_[True, changes(columns[:d])])
            count = np.add.reduceat(n, starts)
            part = [c[starts] for c in columns[:d]]
            split = is_heavy(heavy, lang, self.ids, part)
            for i in np.flatnonzero(split).tolist():
                count[i] = known[(lang, tuple(words[c[i]] for c in part))]
            wanted = (part[-1] != 0) & (count >= least) & ~split
            at = starts[wanted]
            lefts = np.stack([a[at] for a in above], axis=1) if above else np.empty((at.size, 0), np.int64)
            offsets = pa.array(np.arange(0, lefts.size + 1, d - 1) if d > 1 else np.zeros(at.size + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * at.size, pa.string()), joined(words, [c[wanted] for c in part]),
                 pa.array(np.full(at.size, d), pa.int32()), pa.array(count[wanted], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(lefts.ravel(), pa.int64()))], names=["lang", "phrase", "words", "f", "lefts"])
            above.append(np.repeat(count, np.diff(np.r_[starts, n.size])))


NODES = "lang string, phrase string, words int, f long, lefts array<long>"


def frequent_phrases(texts: DataFrame, most_words: int, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(nodes ``lang, phrase, words, f, lefts`` of ``least`` occurrences or more, all words' counts ``lang, prefix, f``).

    ``lefts`` are the counts of the phrase's first 1, 2, ... words.
    """
    words, heavy, known, budget = heavy_prefixes(texts, most_words, budget)
    total = words.agg(F.sum("f")).first()[0] or 0
    groups = max(1, -(-2 * total // budget))
    spark = texts.sparkSession
    blocks = blocks_of_groups(texts, most_words, heavy, groups)
    parts = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // 8)))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                group, lang, *block = (batch.column(c)[i].as_py() for c in range(5))
                if (group, lang) != now:
                    if tree:
                        yield from tree.nodes(now[1], heavy, known, least)
                    now, tree = (group, lang), Subtrees(most_words)
                tree.add(*block)
        if tree:
            yield from tree.nodes(now[1], heavy, known, least)

    found = blocks.repartition(parts, "group").sortWithinPartitions("group", "lang").mapInArrow(nodes, NODES)
    # Prefixes over the budget, counted when they were found.
    over = [(lang, b" ".join(p).decode(), len(p), f, [known[(lang, p[:d])] for d in range(1, len(p))]) for (lang, p), f in known.items()]
    return written(found.union(spark.createDataFrame(over, NODES)), "phrase-nodes"), words


def scored(nodes: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of each phrase of two words or more: its lowest-scoring cut."""
    parts = F.split("phrase", " ")
    cuts = nodes.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.posexplode("lefts").alias("k", "l"), parts.alias("_w"))
    cuts = cuts.select("lang", "phrase", "words", "a", F.col("k") + 1, "l", F.expr("array_join(slice(_w, k + 2, words - k - 1), ' ')").alias("rest")).toDF(
        "lang", "phrase", "words", "a", "k", "l", "rest")
    rests = nodes.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = "cast(1000000 * cast(a AS decimal(15, 0)) * a AS decimal(38, 0)) div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0)))"
    valued = written(cuts.join(rests, ["lang", "rest"]), "phrase-cuts").withColumn("score", F.expr(exact))
    best = valued.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    return best.select("lang", "phrase", "words", "a", "_c.l", "_c.r", "_c.score")


def without_contained(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates whose words are in no longer candidate of ``percent`` hundredths of their occurrences or more."""
    w = F.split("phrase", " ")
    inner = candidates.filter("words > 2").select("lang", "a", "words", w.alias("_w"), F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "a", "size", "_w", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at")).select(
        "lang", F.expr("array_join(slice(_w, at, size), ' ')").alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    joined_ = candidates.join(longest, ["lang", "phrase"], "left")
    return joined_.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def best_of_language(candidates: DataFrame, most: int) -> DataFrame:
    """Each language's first ``most``, with ``rank``.

    The candidates of a language are cut to ``most`` in as many parts as there are shuffle partitions, then in the
    square root of so many, before they meet.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = candidates
    for n in (parts, math.isqrt(parts)):
        salted = few.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(n)))
        few = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_n") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(
        F.col("rank") <= most).drop("_part", "_n")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, contained_percent: int = 50, most: int = 2000,
                 budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``most_words`` words."""
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").alias("text"))
    nodes, words = frequent_phrases(texts, most_words, least, budget)
    candidates = written(scored(nodes), "phrase-candidates")
    best = best_of_language(without_contained(candidates, contained_percent), most)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
