"""Sharding by sampled splitters: near-equal bytes, neighbouring keys together.

Records are ordered by (hash of the text, id, hash of the row's address), so copies of a text are
neighbours and yet a text with many copies can be cut anywhere, also where rows repeat or ids are null. Splitters are
quantiles of a key sample drawn with probability proportional to record size;
records are range-partitioned by them. Every range is then measured: one that
holds more than twice its share is subdivided by splitters from a denser
sample of that range. Exact range totals and running sums inside each range give
every record's byte and row position in the whole order, and a shard is an
equal slice of the byte positions: a shard is off its share by at most one record's size.

Only ids, sizes and hashes are shuffled; the sample and the range totals are the
only things collected, bounded by ``MAX_RANGES * OVERSAMPLE`` expected keys and by
the number of ranges.

Defined cases: a null text has size 16 (the per-record overhead) and crc 0; null ids
come first among equal texts; repeated rows take neighbouring slots; an empty table
gives an empty result; with fewer records than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.rows import text_or_empty, written

OVERHEAD = 16        # bytes counted per record beside its text
RANGE_BYTES = 64 << 20
KEY = ("key", "tie", "spot")
MAX_RANGES = 10_000
OVERSAMPLE = 20      # expected sampled keys per range
OVERFULL = 2         # times its share
REFINE_ROUNDS = 8


def record_keys(source: DataFrame) -> DataFrame:
    """``at, key, tie, spot, doc_id, size, text_crc32`` of each row of ``located(docs)``."""
    text = text_or_empty("doc.text")
    return source.select(
        "at", F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(1 << 63))).alias("tie"),
        F.xxhash64("at").alias("spot"),
        F.col("doc.doc_id").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))


def sampled(records: DataFrame, rate: float, seed: int) -> np.ndarray:
    """Sorted keys (n, 3), each record drawn with probability ``min(1, size * rate)``, by hash."""
    u = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    rows = records.filter(u < F.col("size") * F.lit(rate)).select(*KEY).toPandas()
    return np.unique(rows.to_numpy(dtype=np.int64).reshape(-1, len(KEY)), axis=0)


def quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    if len(keys) == 0 or parts < 2:
        return keys[:0]
    picks = np.arange(1, parts) * len(keys) // parts
    return np.unique(keys[picks], axis=0)


def in_ranges(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds ``range``: how many splitters are at or below the record's key, of as many columns as the splitters have."""
    keys, *ties = [np.ascontiguousarray(c) for c in splitters.T]

    @F.pandas_udf("int")
    def range_of(*columns: pd.Series) -> pd.Series:
        k, *t = [c.to_numpy() for c in columns]
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        while (open_ := np.flatnonzero(low < high)).size:  # splitters with this very key: search by the other columns
            mid = (low[open_] + high[open_]) // 2
            below = np.ones(len(open_), bool)
            for split, own in reversed(list(zip(ties, t))):
                below = (split[mid] < own[open_]) | ((split[mid] == own[open_]) & below)
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return pd.Series(low.astype(np.int32))

    return records.withColumn("range", range_of(*KEY[:splitters.shape[1]]))


def range_totals(ranged: DataFrame) -> pd.DataFrame:
    """``range, bytes, rows`` by range; at most as many rows as ranges."""
    return ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")) \
        .toPandas().sort_values("range").reset_index(drop=True)


def ranges_of(records: DataFrame, ranges: int | None = None, shards: int = 40) -> tuple[DataFrame, pd.DataFrame]:
    """Records with their ``range``, and the measured totals; no range over twice its share that can be cut."""
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = ranges or int(min(MAX_RANGES, max(4 * shards, -(-total // RANGE_BYTES))))
    share = max(1.0, total / ranges)
    rate = OVERSAMPLE / share
    splitters = quantiles(sampled(records, rate, 0), ranges)
    for i in range(1, REFINE_ROUNDS + 1):
        ranged = in_ranges(records, splitters)
        totals = range_totals(ranged)
        over = totals[(totals["bytes"] > OVERFULL * share) & (totals["rows"] > 1)]
        if over.empty:
            break
        more = [splitters]
        dense = sampled(ranged.filter(F.col("range").isin([int(x) for x in over["range"]])), rate * 4 ** i, i)
        cut = np.array([tuple(x) for x in splitters], dtype="i8,i8,i8")
        place = np.searchsorted(cut, np.array([tuple(x) for x in dense], dtype="i8,i8,i8"), "right")
        for r, size in zip(over["range"], over["bytes"]):
            more.append(quantiles(dense[place == r], int(-(-size // share))))
        grown = np.unique(np.concatenate(more), axis=0)
        if len(grown) == len(splitters):
            break
        splitters = grown
    return ranged, totals


def shards(source: DataFrame, n: int = 40, ranges: int | None = None) -> DataFrame:
    """``at, doc_id, size, text_crc32, shard, slot`` for each row of ``located(docs)``."""
    spark = source.sparkSession
    records = written(record_keys(source), "record-keys")
    ranged, totals = ranges_of(records, ranges, n)
    total = int(totals["bytes"].sum())
    before = totals.assign(bytes=totals["bytes"].cumsum() - totals["bytes"], rows=totals["rows"].cumsum() - totals["rows"])
    offsets = spark.createDataFrame(
        [tuple(map(int, x)) for x in before[["range", "bytes", "rows"]].itertuples(index=False)],
        "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy(*KEY, "at")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select(
        "range", "at", "doc_id", "size", "text_crc32",
        F.coalesce(F.sum("size").over(running), F.lit(0)).alias("bytes_in"),
        (F.row_number().over(order) - 1).alias("rows_in"))
    # One row per range, MAX_RANGES at first and a few more per subdivided range.
    placed = placed.join(F.broadcast(offsets), "range").select(
        "at", "doc_id", "size", "text_crc32",
        # The slice that the middle of the record lies in.
        F.expr(f"int((2 * (bytes_before + bytes_in) + size) * {n} div {max(2 * total, 1)})").alias("shard"),
        (F.col("rows_before") + F.col("rows_in")).alias("place"))
    placed = written(placed, "placed-records")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most n rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "at", "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(source: DataFrame, assigned: DataFrame, path: str) -> None:
    """``located(docs)`` as one Parquet folder per shard; a shard's files hold consecutive slots."""
    rows = source.join(assigned.select("at", "shard", "slot"), "at")
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", "doc").write.partitionBy("shard").parquet(path))
