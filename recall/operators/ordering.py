"""Positions inside (possibly huge) ordered groups without a one-task window.

``row_number().over(partitionBy(g).orderBy(o))`` sends each group to one task,
so one hot group stalls the job. Here the rows are range-partitioned on
``(g, o)`` (a hot group is split across many tasks), each partition numbers its
rows locally, and a per-(partition, group) summary — at most
``partitions + groups`` rows — supplies the offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall.session import ensure_checkpoint_dir

# The offsets table is broadcast when it is at most this many rows (measured
# before the join; a few small columns per row). Larger tables are joined by
# shuffle, which stays skew-free because a hot group is spread over partitions.
BROADCAST_SUMMARY_ROWS = 200_000


# Rows a range partition should hold: an explicit partition count is never split
# afterwards, so it is derived from the input's size.
ROWS_PER_RANGE = 2_000_000


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range shuffle of ``df``: the session's count, more when that leaves too many rows in each.

    Counts the rows: ``df`` should be a table, whose files' footers hold their numbers.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // ROWS_PER_RANGE))


def first_within(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their 1-based ``rank``.

    ``order_cols`` must order a group's rows totally. No task sees a whole group: every input partition
    keeps its own first ``k`` of a group, the square root of so many bundles of partitions do the
    same, and the last window ranks what these left, ``k`` rows from each bundle. Up to ``k`` of
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) rows are cut before each shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = max(1, math.isqrt(max(parts, df.sparkSession.sparkContext.defaultParallelism)))
    out = df.withColumn("_bundle", F.pmod(F.spark_partition_id(), F.lit(bundles)))
    for keys in (["_bundle", *group_cols], group_cols):
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols))
        out = out.withColumn(rank, at.cast("long")).where(F.col(rank) <= k)
    return out.drop("_bundle")


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], *,
                num_partitions: int | None = None, position: str = "position",
                total: str | None = "total") -> DataFrame:
    """Add 1-based ``position`` within each group by ``order_cols`` (and ``total``).

    ``(group_cols, order_cols)`` must be unique for a deterministic result.
    """
    spark = df.sparkSession
    n = num_partitions or range_partitions(df)
    keys = [*group_cols, *order_cols]
    # Range bounds are sampled from the input, whose row order after a shuffle
    # is not fixed; the summary and the rows below must see the very same
    # partitions, so the partitioned data is cut into a reliable checkpoint.
    ensure_checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    summary = ranged.groupBy("_pid", *group_cols).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    # One row per (partition, group): a group spans at most n of them.
    by_group = Window.partitionBy(*group_cols).orderBy("_pid")
    cols = [
        "_pid", *group_cols, "_first",
        F.coalesce(F.sum("_cnt").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    ]
    if total:
        cols.append(F.sum("_cnt").over(Window.partitionBy(*group_cols)).alias(total))
    summary = summary.select(*cols)
    if summary.count() <= BROADCAST_SUMMARY_ROWS:
        summary = F.broadcast(summary)
    out = ranged.join(summary, ["_pid", *group_cols], "inner")
    out = out.withColumn(position, F.col("_mid") - F.col("_first") + F.col("_before") + F.lit(1))
    return out.drop("_pid", "_mid", "_first", "_before")
