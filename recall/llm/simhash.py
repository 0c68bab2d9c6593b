"""Near-duplicates by 64-bit SimHash fingerprints, linked by multi-index hashing.

Fingerprints are cut into three segments. Two fingerprints with at most four
differing bits have at most one differing bit in the first or the second segment, or
an equal third one (were it 2 + 2 + 1, they would differ in five). So each
fingerprint enters three tables under its segments' values, and looks up in each
table the small Hamming ball around its own value: the value itself, and in the first
two tables the values with one more bit set (of two values that differ in one
bit one has that bit clear, so flipping clear bits finds the pair from one side).
Every match is verified on all 64 bits.

Equal fingerprints count once. Looked-up rows and table rows meet by (table, value),
sorted, and are compared in NumPy blocks. Of the verified links of a value only a
spanning forest leaves the task: a dense group gives as many links as members,
not all pairs. A value that more than ``CHUNK`` fingerprints share is cut into
chunks; each pair of chunks is compared by a task of its own once the links inside
the chunks have been contracted, and there only fingerprints outside the value's largest
component need to look for links with the others. So no link is lost,
and no task holds more than two chunks.

Defined cases: a null or blank text has fingerprint 0, which links like any other; fewer words than
the shingle length make one shingle; repeated rows are in one component; null ids never name a
component unless it has no other; an empty table gives an empty result; a very long text is read in blocks, in
place. Only the rows' ``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.llm.components import components
from recall.llm.rows import located, text_views, word_blocks, written

BITS = 64
SEED = 42
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))  # first bit, width, radius of the ball
CHUNK = 4096
BLOCK = 1 << 21  # pairs compared at once
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: memoryview, words_per_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, block by block: the last words of a block start the next one's shingles."""
    digest, last, any_yet = xxhash.xxh64_intdigest, [], False
    for words in word_blocks(text, LOWER):
        words = last + words
        if len(words) >= words_per_shingle:
            any_yet = True
            joined = b" ".join(words)
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            starts = np.r_[0, gaps[:len(gaps) + 1 - words_per_shingle] + 1]
            ends = np.r_[gaps[words_per_shingle - 1:], len(joined)]
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
        last = words[-(words_per_shingle - 1):] if words_per_shingle > 1 else []
        if not any_yet:
            last = words
    if last and not any_yet:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def fingerprint(text: memoryview, words_per_shingle: int) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words_per_shingle):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            ones += np.add.reduce(bits[at:at + 255], axis=0, dtype=np.uint8)
        n += len(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(source: DataFrame, words_per_shingle: int) -> DataFrame:
    """``at, doc_id, fp`` (the 64 bits as a signed long) for each row of ``located(docs)``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words_per_shingle) for t in text_views(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                             names=["at", "doc_id", "fp"])

    return source.select("at", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text").mapInArrow(
        rows, "at struct<file:string,row:bigint>, doc_id long, fp long")


def own_values(distinct: DataFrame) -> DataFrame:
    """``fp, table, own``: the segments of each fingerprint."""
    by_table = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(SEGMENTS) - 1))).alias("table"))
    own = F.coalesce(*[
        F.when(F.col("table") == k, F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)))
        for k, (first, width, _) in enumerate(SEGMENTS)])
    return by_table.withColumn("own", own)


def reached(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``table, own``) under each value of their ball: ``value`` and ``stored`` (their own value) are added.

    ``value`` has the table's number above the segment's bits.
    """
    flips = F.coalesce(*[F.when(F.col("table") == k, F.lit(radius * width)) for k, (_, width, radius) in enumerate(SEGMENTS)])
    stepped = rows.withColumn("step", F.explode(F.sequence(F.lit(0), flips)))
    bit = F.expr("if(step = 0, 0L, shiftleft(1L, step - 1))")
    return stepped.filter((F.col("step") == 0) | (F.col("own").bitwiseAND(bit) == 0)).withColumn(
        "value", F.col("own").bitwiseOR(bit).bitwiseOR(F.expr("shiftleft(cast(table AS long), 60)"))).withColumn(
        "stored", F.col("step") == 0).drop("step", "table", "own")


def entries(distinct: DataFrame) -> DataFrame:
    """``fp, value, stored``: the table rows (stored) and the ball look-ups of each fingerprint."""
    return reached(own_values(distinct))


def crowded_values(distinct: DataFrame, chunk_rows: int) -> DataFrame:
    """``value, chunks`` of the values that more than ``chunk_rows`` entries may have.

    Counted from the segments' own values, not from all look-ups. A value is reached from its own rows and from
    fewer than 64 other values, so those of under ``chunk_rows / 128`` rows add at most half of
    ``chunk_rows``, which is allowed for; only the others are followed to the values that they reach.
    """
    many = own_values(distinct).groupBy("table", "own").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") * 128 >= chunk_rows)
    members = reached(many).groupBy("value").agg(F.sum("rows").alias("members")).filter(F.col("members") * 2 > chunk_rows)
    return members.select("value", F.ceil(F.col("members") / chunk_rows + 0.5).cast("int").alias("chunks"))


def forest(fp: np.ndarray, most: int) -> np.ndarray:
    """Links (n, 2) that span the components of fingerprints at most ``most`` bits apart.

    Breadth first: found members leave the pool, so a dense group costs about one comparison a member.
    """
    links, pool = [np.empty((0, 2), np.uint64)], np.unique(fp)
    while pool.size:
        front, pool = pool[:1], pool[1:]
        while front.size and pool.size:
            found = [np.empty(0, np.uint64)]
            step = max(1, BLOCK // pool.size)
            for at in range(0, front.size, step):
                near = np.bitwise_count(front[at:at + step, None] ^ pool[None, :]) <= most
                hit = near.any(axis=0)
                found.append(pool[hit])
                links.append(np.stack([front[at + near[:, hit].argmax(axis=0)], pool[hit]], axis=1))
                pool = pool[~hit]
            front = np.concatenate(found)
    return np.concatenate(links)


FEW = 16


def run_links(value: np.ndarray, fp: np.ndarray, stored: np.ndarray, most: int) -> np.ndarray:
    """Spanning links (n, 2) inside each value of rows sorted by value.

    Values with few rows are compared all at once, by offset; look-ups that met no table row are left out.
    """
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    sizes = np.diff(np.r_[starts, value.size])
    useful = np.logical_or.reduceat(stored, starts) & (sizes > 1)
    out = [np.empty((0, 2), np.uint64)]
    few = np.repeat(useful & (sizes <= FEW), sizes)
    for d in range(1, min(FEW, value.size)):
        a = np.flatnonzero((value[d:] == value[:-d]) & few[d:])
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= most]
        out.append(np.stack([fp[a], fp[a + d]], axis=1))
    for i in np.flatnonzero(useful & (sizes > FEW)):
        out.append(forest(fp[starts[i]:starts[i] + sizes[i]], most))
    links = np.concatenate(out)
    return np.unique(np.sort(links[links[:, 0] != links[:, 1]], axis=1), axis=0)


LINKS = "a long, b long"


def as_links(pairs: np.ndarray) -> pa.RecordBatch:
    signed = np.ascontiguousarray(pairs).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first, cut only between its values."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
        if rest[0].size and rest[0][0] != rest[0][-1]:
            cut = int(np.searchsorted(rest[0], rest[0][-1], "left"))
            yield [x[:cut] for x in rest]
            rest = [x[cut:] for x in rest]
    if rest is not None and rest[0].size:
        yield rest


def links_within(keyed: DataFrame, most: int) -> DataFrame:
    """Links among the rows ``(key, fp, stored)`` of each key."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, stored in runs(batches, ["key", "fp", "stored"]):
            yield as_links(run_links(key, fp.view(np.uint64), stored, most))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(links, LINKS)


def links_across(members: DataFrame, within: DataFrame, most: int) -> DataFrame:
    """Links between the chunks of crowded values, given the links inside them.

    ``members``: value, chunks, chunk, fp. Members outside their value's largest component so far are the
    queries; chunk by chunk of them meets every chunk of the value.
    """
    named = members.join(components(within), members["fp"] == F.col("a"), "left").select(
        "value", "chunks", "chunk", "fp", F.coalesce("root", "fp").alias("label"))
    named = written(named, "crowded-members")
    by_label = named.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
    top = by_label.groupBy("value").agg(F.max_by("label", F.struct("n", "label")).alias("top"),
                                        F.sum("n").alias("all"), F.max("n").alias("most"))
    top = top.select("value", "top", F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int").alias("parts")).filter("parts > 0")
    named = named.join(top, "value")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = named.filter("label != top").select(
        "value", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int").alias("part"),
        each("chunks").alias("chunk"), "fp", "label", F.lit(True).alias("query"))
    others = named.select("value", each("parts").alias("part"), "chunk", "fp", "label", F.lit(False).alias("query"))
    keyed = queries.unionByName(others).select(F.xxhash64("value", "part", "chunk").alias("key"), "fp", "label", "query")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, label, query in runs(batches, ["key", "fp", "label", "query"]):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], key.size]):
                yield as_links(joining(fp[a:b].view(np.uint64), label[a:b], query[a:b], most))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(links, LINKS)


def joining(fp: np.ndarray, label: np.ndarray, query: np.ndarray, most: int) -> np.ndarray:
    """One verified link for each two labels that queries and the other rows have in common."""
    q, o = np.flatnonzero(query), np.flatnonzero(~query)
    out = [np.empty((0, 2), np.uint64)]
    step = max(1, BLOCK // max(1, o.size))
    for at in range(0, q.size, step):
        a, b = np.nonzero((np.bitwise_count(fp[q[at:at + step], None] ^ fp[o][None, :]) <= most)
                          & (label[q[at:at + step], None] != label[o][None, :]))
        a, b = q[a + at], o[b]
        _, first = np.unique(np.stack([label[a], label[b]], axis=1), axis=0, return_index=True)
        out.append(np.stack([fp[a[first]], fp[b[first]]], axis=1))
    return np.concatenate(out)


def fingerprint_links(distinct: DataFrame, most: int, chunk_rows: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints (column ``fp``), with the components of all links.

    ``most`` differing bits at most; the segments are cut for up to 4.
    """
    if most > 4:
        raise ValueError("the segments hold for up to 4 differing bits")
    rows = entries(distinct)
    crowded = written(crowded_values(distinct, chunk_rows), "crowded-values")
    if crowded.isEmpty():
        keyed = rows.select(F.col("value").alias("key"), "fp", "stored")
        return written(links_within(keyed, most), "fingerprint-links")
    rows = rows.join(crowded, "value", "left")
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    # A chunk of look-ups only is still compared: the table rows may be in another chunk.
    keyed = rows.select(F.xxhash64("value", chunk).alias("key"), "fp", (F.col("stored") | F.col("chunks").isNotNull()).alias("stored"))
    within = written(links_within(keyed, most), "fingerprint-links")
    members = rows.filter(F.col("chunks").isNotNull()).select("value", "chunks", chunk.alias("chunk"), "fp")
    return written(within.union(links_across(members, within, most)), "all-fingerprint-links")


def near_groups(source: DataFrame, words_per_shingle: int = 4, most: int = 4, chunk_rows: int = CHUNK) -> DataFrame:
    """``at, doc_id, fp, component_id, kept`` for each row of ``located(docs)``.

    ``component_id`` is the smallest id among all rows reachable over links; ``kept`` marks one row of
    each component, the one with that id (the first by address if several have it).
    """
    prints = written(fingerprints(source, words_per_shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at"))
    distinct = written(prints.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct.select("fp"), most, chunk_rows))
    rooted = distinct.join(roots, distinct["fp"] == F.col("a"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = written(rooted.groupBy("root").agg(F.min("first").alias("first")), "component-firsts")
    of_print = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return prints.join(of_print, "fp").select(
        "at", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("at") == F.col("first.at")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 4, most: int = 4) -> DataFrame:
    """``docs`` with one row of each component."""
    source = located(docs)
    dropped = near_groups(source, words_per_shingle, most).filter(~F.col("kept")).select("at")
    return source.join(dropped, "at", "left_anti").select("doc.*")
