"""Exact deduplication with a keyed, disk-backed streaming state.

The digests of all texts form a log; a streaming aggregation over the log keeps
one state row per digest in RocksDB, never expired: the smallest document id
(stable identifier), the address of that row's content (file and row), and how
many rows had the digest. A digest seen before is only a hit: the hit's full
text is then compared with the text at the kept address, and rows that
differ (a digest collision) are grouped again by their text.

Everything on the path is DataFrame work; no key is gathered in one task: the
state is built from per-task partial aggregates, and the joins on a digest or an
address are plain sort-merge joins that adaptive execution splits when a key is hot.

Defined cases: a null text counts as empty; null ids sort after all others; of
rows with equal id and text the first by address stays; an empty table gives an
empty result; further columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.llm.rows import located, written
from recall.session import shared_dir

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: take disk space as it is needed, not in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 10_000  # digest-log files a micro-batch takes


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digest_state(spark: SparkSession, log: str, schema, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """State ``(digest, first, n)`` after the stream has taken every file of the digest log.

    Each micro-batch writes the rows of the state that it changed, in a folder of its
    own that a replay overwrites; the newest row of a digest is the one with the largest count.
    """
    changes = shared_dir(spark, "llm", "digest-changes")
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        keyed = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
            .groupBy("digest")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("first"),
                 F.count(F.lit(1)).alias("n")))
        out_schema = keyed.schema
        query = (
            keyed.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", shared_dir(spark, "llm", "digest-state"))
            .foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{changes}/batch={i}"))
            .start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    rows = spark.read.schema(out_schema).option("basePath", changes).parquet(f"{changes}/batch=*") \
        if query.lastProgress else spark.createDataFrame([], out_schema)
    return rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def exact_groups(source: DataFrame, digest: Callable[[Column], Column] = sha256,
                 files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per row of ``located(docs)``: at, doc_id, digest, keep_id, group_size, kept."""
    spark = source.sparkSession
    rows = source.select("at", F.col("doc.doc_id").alias("doc_id"), normalised(F.col("doc.text")).alias("norm"))
    log_path = shared_dir(spark, "llm", "digest-log")
    log_rows = rows.select("at", "doc_id", digest(F.col("norm")).alias("digest"))
    log_rows.write.parquet(log_path)
    log = spark.read.schema(log_rows.schema).parquet(log_path)
    # Written: a join of two plain tables can be split where a digest is hot, one with an aggregate cannot.
    state = written(digest_state(spark, log_path, log_rows.schema, files_per_batch), "digest-state-rows")

    seen = log.join(state, "digest").select("at", "doc_id", "digest", "first", "n")
    hits = seen.filter("n > 1").select("at", "doc_id", "digest", "first")
    # Full texts of the rows that share a digest, by address; then each against the kept row's.
    texts = written(rows.select("at", "norm").join(hits, "at"), "hit-texts")
    kept_text = texts.filter(F.col("at") == F.col("first.at")).select(
        F.col("at").alias("kept_at"), F.col("norm").alias("kept_norm"))
    differ = written(
        texts.filter(F.col("at") != F.col("first.at"))
        .join(kept_text, F.col("first.at") == F.col("kept_at"))
        .filter(F.col("norm") != F.col("kept_norm"))
        .select("at", "doc_id", "digest", "norm"), "digest-collisions")
    if not differ.isEmpty():
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at"))
        own = differ.groupBy("digest", "norm").agg(first.alias("own_first"), F.count(F.lit(1)).alias("own_n"))
        apart = differ.join(own, ["digest", "norm"]).select("at", "own_first", "own_n")
        lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        seen = seen.join(apart, "at", "left").join(lost, "digest", "left").select(
            "at", "doc_id", "digest", F.coalesce("own_first", "first").alias("first"),
            F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
    return seen.select("at", "doc_id", "digest", F.col("first.doc_id").alias("keep_id"),
                       F.col("n").alias("group_size"), (F.col("at") == F.col("first.at")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose normalised text an earlier id (then address) already has."""
    source = located(docs)
    dropped = exact_groups(source).filter(~F.col("kept")).select("at")
    return source.join(dropped, "at", "left_anti").select("doc.*")
