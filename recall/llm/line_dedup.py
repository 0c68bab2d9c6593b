"""Removing lines that many documents share, with a sharded minimal perfect hash.

Pass 1 hashes each document's distinct line keys to 128 bits, counts them per
Arrow batch and sums the counts in Spark (a line found everywhere is one row per
batch). Pass 2 builds, for each shard of all distinct hashes, a
minimal perfect hash with two arrays in its order: 64-bit fingerprints (the
other half of the hash, so foreign lines are rejected) and document counts; besides them the hash itself takes a few bits a line.
Pass 3 streams the documents again: each line probes the arrays for its count; lines
are never joined or shuffled as text.

The arrays are broadcast when their measured size is at most ``BROADCAST_BYTES``.
Beyond that each line's hash travels to the task that holds its shard, and only the numbers of
the lines to drop come back to the documents. How many probes a shard gets is known from its counts:
one with more than ``PROBES_PER_TASK`` (a line that every document has) is probed by so many tasks more.

Defined cases: a null or empty text is one empty line; empty keys are never dropped when
``min_chars`` is 1 or more; a line repeated in a document counts once for it; repeated
rows are separate documents; a document that loses all lines keeps the empty text; an
empty table gives an empty result; further columns, whatever their names, are left aside; all lines of one text are held at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import written

BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
KEYS_PER_SHARD = 1 << 18
BROADCAST_BYTES = 4 << 20  # each Python worker holds its copy
PROBES_PER_TASK = 1 << 22
RANK_BITS = 512  # one rank is kept for so many bits
GAMMA = 2.0


def line_hashes(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """The lines, and each line key's 128-bit hash (None for keys under ``min_chars`` code points)."""
    lines = (text or "").split("\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.encode("utf-8", "surrogatepass").strip(BLANK).translate(LOWER)
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        hashes.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return lines, hashes


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_counts(texts: DataFrame, min_chars: int) -> DataFrame:
    """``place, print, docs``: both halves of a line key's hash and how many documents have the line."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                seen.update({h for h in line_hashes(text.as_py(), min_chars)[1] if h is not None})
            if seen:
                place, check = halves(list(seen))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place.view("<i8")), pa.array(check.view("<i8")), pa.array(list(seen.values()), pa.int64())],
                    names=["place", "print", "docs"])

    partial = texts.mapInArrow(count, "place long, print long, docs long")
    return partial.groupBy("place", "print").agg(F.sum("docs").alias("docs"))


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another well-spread hash of ``h`` for each level (the splitmix64 finaliser; fixed values)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(place: np.ndarray, check: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(place ^ mixed(check, level), level) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: per level a bit array, a key's slot is the rank of its bit.

    A key sits in the first level where no other remaining key has its position.
    Unknown keys get some slot or -1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = [np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)]) for bits in levels]
        self.sizes = [8 * len(bits) for bits in levels]
        per_block = [np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.int64) for bits in self.levels]
        self.ranks = [np.cumsum(n) - n for n in per_block]  # set bits before each block
        self.starts = np.cumsum([0] + [int(n.sum()) for n in per_block])

    def ranks_of(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position of a level."""
        out = np.empty(at.size, np.int64)
        for a in range(0, at.size, 1 << 16):
            some = at[a:a + (1 << 16)]
            block = some // RANK_BITS
            own = self.levels[level].reshape(-1, RANK_BITS // 8)[block]
            byte, bit = some % RANK_BITS // 8, (some % 8).astype(np.uint8)
            before = np.where(np.arange(RANK_BITS // 8) < byte[:, None], np.bitwise_count(own), 0).sum(axis=1)
            last = np.bitwise_count(own[np.arange(some.size), byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[a:a + (1 << 16)] = self.ranks[level][block] + before + last
        return out

    @staticmethod
    def build(place: np.ndarray, check: np.ndarray) -> list[np.ndarray]:
        levels: list[np.ndarray] = []
        while place.size:
            size = max(64, int(GAMMA * place.size + 7) // 8 * 8)
            at = positions(place, check, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            place, check = place[left], check[left]
        return levels

    def slots(self, place: np.ndarray, check: np.ndarray) -> np.ndarray:
        out = np.full(place.size, -1, np.int64)
        open_ = np.arange(place.size)
        for i, bits in enumerate(self.levels):
            at = positions(place[open_], check[open_], i, self.sizes[i])
            here = bits[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1
            out[open_[here]] = self.starts[i] + self.ranks_of(i, at[here])
            open_ = open_[~here]
        return out


class Shard:
    """The arrays of one shard, ready to probe."""

    def __init__(self, row: dict):
        sizes, blob = row["sizes"], np.frombuffer(row["bits"], np.uint8)
        cuts = np.cumsum([0, *sizes])
        self.hash = PerfectHash([blob[a:b] for a, b in zip(cuts, cuts[1:])])
        self.prints = np.frombuffer(row["prints"], "<u8")
        self.docs = np.frombuffer(row["docs"], "<i8")

    def counts(self, place: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Documents that have the line; 0 for lines not in the index."""
        slot = self.hash.slots(place, check)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == check[found]
        out = np.zeros(place.size, np.int64)
        out[found] = self.docs[slot[found]]
        return out


def shard_of(shards: int) -> Column:
    """The shard of a hash: the upper half of ``place``, as ``slice_of`` has it."""
    return F.pmod(F.shiftrightunsigned("place", 32), F.lit(shards)).cast("int")


INDEX = "shard int, sizes array<int>, bits binary, prints binary, docs binary, probes long"


def build_index(counts: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """One row of arrays per shard, and the number of shards; written, about ``keys_per_shard`` hashes each."""
    counts = written(counts, "line-counts")
    shards = max(1, -(-counts.count() // keys_per_shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        place, check = pdf["place"].to_numpy().view("<u8"), pdf["print"].to_numpy().view("<u8")
        levels = PerfectHash.build(place, check)
        slot = PerfectHash(levels).slots(place, check)
        prints, docs = np.empty(place.size, "<u8"), np.empty(place.size, "<i8")
        prints[slot], docs[slot] = check, pdf["docs"].to_numpy()
        return pd.DataFrame([{
            "shard": int(pdf["shard"].iloc[0]), "sizes": [len(x) for x in levels],
            "bits": b"".join(x.tobytes() for x in levels), "prints": prints.tobytes(), "docs": docs.tobytes(), "probes": int(docs.sum())}])

    sharded = counts.withColumn("shard", shard_of(shards))
    return written(sharded.groupBy("shard").applyInPandas(build, INDEX), "line-index"), shards


def without(lines: list[str], drop: np.ndarray) -> str:
    return "\n".join(line for line, gone in zip(lines, drop) if not gone)


AT = "at struct<file:string,row:bigint>"
RESULT = f"{AT}, doc_id long, n_lines long, n_dropped long, kept_text string"


def texts_of(source: DataFrame) -> DataFrame:
    return source.select("at", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text")


def drop_in_place(source: DataFrame, index: list[dict], shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """``at, doc_id, n_lines, n_dropped, kept_text``: every document probes the broadcast arrays."""
    shared = source.sparkSession.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {row["shard"]: Shard(row) for row in shared.value}
        for batch in batches:
            docs = [line_hashes(t.as_py(), min_chars) for t in batch.column("text")]
            flat = [h for _, hashes in docs for h in hashes if h is not None]
            gone = np.zeros(len(flat), bool)
            if flat and arrays:
                place, check = halves(flat)
                for shard, ours in by_shard(place, shards):
                    if shard in arrays:
                        gone[ours] = arrays[shard].counts(place[ours], check[ours]) >= min_docs
            out, i = [], 0
            for lines, hashes in docs:
                drop = np.zeros(len(lines), bool)
                for j, h in enumerate(hashes):
                    if h is not None:
                        drop[j] = gone[i]
                        i += 1
                out.append((len(lines), int(drop.sum()), without(lines, drop)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("doc_id"), *[pa.array(x) for x in zip(*out)]],
                names=["at", "doc_id", "n_lines", "n_dropped", "kept_text"])

    return texts_of(source).mapInArrow(probe, RESULT)


def by_shard(place: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has rows, with their places."""
    own = slice_of(place, shards)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for rows in np.split(order, cuts):
        if rows.size:
            yield int(own[rows[0]]), rows


def slice_of(place: np.ndarray, shards: int) -> np.ndarray:
    return ((place >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def drop_by_shard(source: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int,
                  probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """The same result when the arrays are too large for one task: probes travel to their shard's task.

    Inside a partition the rows are sorted by (shard, salt), the arrays before the probes, and
    streamed, so one shard's arrays and one Arrow batch are in memory at a time.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, line, flat = [], [], []
            for where, text in zip(batch.column("at").to_pylist(), batch.column("text")):
                for j, h in enumerate(line_hashes(text.as_py(), min_chars)[1]):
                    if h is not None:
                        at.append(where)
                        line.append(j)
                        flat.append(h)
            if flat:
                place, check = halves(flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.struct([("file", pa.string()), ("row", pa.int64())])), pa.array(line, pa.int32()),
                     pa.array(place.view("<i8")), pa.array(check.view("<i8"))], names=["at", "line", "place", "print"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, arrays = None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            line = batch.column("line")
            is_index = np.asarray(line.is_null())
            place = batch.column("place").fill_null(0).to_numpy(zero_copy_only=False).view("<u8")
            check = batch.column("print").fill_null(0).to_numpy(zero_copy_only=False).view("<u8")
            starts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | is_index[1:] | is_index[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], shard.size]):
                if is_index[a]:
                    here, arrays = shard[a], Shard({k: batch.column(k)[int(a)].as_py() for k in ("sizes", "bits", "prints", "docs")})
                elif here == shard[a]:
                    hit = np.flatnonzero(arrays.counts(place[a:b], check[a:b]) >= min_docs) + a
                    if hit.size:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("at").take(pa.array(hit)), line.take(pa.array(hit))], names=["at", "line"])

    probes = texts_of(source).mapInArrow(explode, f"{AT}, line int, place long, print long")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<int>"), ("bits", "binary"), ("prints", "binary"), ("docs", "binary"))]
    # Shards with many probes: at most one for each ``probes_per_task`` of all of them. A repeated line of a document is a probe
    # each time, so the counts are a lower bound.
    salts = F.ceil(F.col("probes") / probes_per_task).cast("int")
    hot = F.broadcast(index.filter(F.col("probes") > probes_per_task).select("shard", salts.alias("salts")))
    probes = probes.select(shard_of(shards).alias("shard"), "at", "line", "place", "print", *none).join(hot, "shard", "left")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("at"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
        F.lit(None).cast("struct<file:string,row:bigint>").alias("at"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("print"), "sizes", "bits", "prints", "docs")
    routed = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("line").isNotNull())
    hits = routed.mapInArrow(probe, f"{AT}, line int").groupBy("at").agg(F.collect_set("line").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                lines = (text.as_py() or "").split("\n")
                drop = np.zeros(len(lines), bool)
                drop[gone.as_py() or []] = True
                out.append((len(lines), int(drop.sum()), without(lines, drop)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("doc_id"), *[pa.array(x) for x in zip(*out)]],
                names=["at", "doc_id", "n_lines", "n_dropped", "kept_text"])

    return texts_of(source).join(hits, "at", "left").mapInArrow(cut, RESULT)


def drop_shared_lines(source: DataFrame, min_docs: int = 10, min_chars: int = 1,
                      broadcast_bytes: int = BROADCAST_BYTES, keys_per_shard: int = KEYS_PER_SHARD,
                      probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """``at, doc_id, n_lines, n_dropped, kept_text`` for each row of ``located(docs)``.

    Lines whose key (stripped, A-Z lower-cased) has at least ``min_chars`` code points and stands in
    at least ``min_docs`` documents are dropped everywhere.
    """
    index, shards = build_index(line_counts(source.select("doc.text"), min_chars), keys_per_shard)
    size = index.agg(F.sum(F.octet_length("bits") + F.octet_length("prints") + F.octet_length("docs"))).first()[0] or 0
    if size <= broadcast_bytes:
        return drop_in_place(source, [row.asDict() for row in index.collect()], shards, min_chars, min_docs)
    return drop_by_shard(source, index, shards, min_chars, min_docs, probes_per_task)
