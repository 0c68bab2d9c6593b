"""Fixed-schema scans of the card store.

Tables are Parquet; columns are selected by name (never by position) and
cast to the store schema, so Catalyst prunes columns and pushes filters to
the scan. The vocabulary is one table partitioned by ``lang``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.schema import CARD, CARD_TAG, REVIEW, WORD


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


# Text given to one task that splits it into words: what such a task gathers (counts, rows to be sorted or sent) takes
# about thirty times as much memory, so the number of tasks follows the text, not the cores or the files.
TASK_TEXT_BYTES = 8_000_000


def spread(df: DataFrame, key: str, text: str = "text", streamed: bool = False) -> DataFrame:
    """Hash-spread ``df`` on ``key``: about ``TASK_TEXT_BYTES`` of ``text`` a task, and two tasks a core at least.

    The bytes are summed by a pass over that column alone: files tell neither the text's size (they are compressed, and
    copies take no room there) nor how finely a reader can split them. Groups by ``key`` and more need no further shuffle.
    ``streamed``: per-row work that gathers nothing; a table of as many files as cores is then returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if streamed and len(df.inputFiles()) >= cores:
        return df
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(2 * cores, -(-size // TASK_TEXT_BYTES)), key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet work table in the shared folder and read it back.

    For intermediate results that several branches of one job read: each branch
    scans the table (pruned, columnar) instead of recomputing it, and a lost
    executor loses nothing.
    """
    from recall.session import shared_dir
    path = shared_dir(df.sparkSession, "work", name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def scan_cards(spark: SparkSession, path: str) -> DataFrame:
    """Card table scan with the store schema (extra columns are ignored)."""
    return _conform(spark.read.schema(CARD).parquet(path), CARD)


def scan_card_tags(spark: SparkSession, path: str) -> DataFrame:
    return _conform(spark.read.schema(CARD_TAG).parquet(path), CARD_TAG)


def scan_review_history(spark: SparkSession, path: str) -> DataFrame:
    return _conform(spark.read.schema(REVIEW).parquet(path), REVIEW)


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    return _conform(spark.read.parquet(path), WORD)


def write_words(words: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One vocabulary table, one folder of few files per language (partition pruning on read)."""
    words.hint("rebalance", "lang").write.mode(mode).partitionBy("lang").parquet(path)


def words_of_language(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Vocabulary of one language; the ``lang`` filter prunes partitions."""
    return scan_words(spark, path).where(F.col("lang") == F.lit(lang))


def write_cards_by_due(cards: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write cards with a materialised ``due_at``, range-clustered and sorted on it.

    ``last_reviewed + review_after_secs < as_of`` cannot reach the Parquet
    reader (arithmetic over two columns); ``due_at < as_of`` can, and with the
    rows clustered by ``due_at`` most row groups are skipped by their min/max
    statistics.
    """
    from recall.functions.text import due_at
    from recall.operators.ordering import range_partitions
    n = files or range_partitions(cards.select("id"))
    # The id is the second key: cards due at one time may fill many files.
    (cards.withColumn("due_at", due_at("last_reviewed", "review_after_secs"))
     .repartitionByRange(n, "due_at", "id").sortWithinPartitions("due_at", "id")
     .write.mode(mode).parquet(path))


def scan_cards_by_due(spark: SparkSession, path: str) -> DataFrame:
    """Cards with their stored ``due_at`` (``write_cards_by_due``); ``cards_due`` filters it in the scan."""
    from pyspark.sql.types import StructField, StructType, TimestampNTZType
    return spark.read.schema(StructType([*CARD.fields, StructField("due_at", TimestampNTZType(), True)])).parquet(path)


def save_card_store(cards: DataFrame, tags: DataFrame, reviews: DataFrame, prefix: str, path: str,
                    buckets: int) -> dict[str, str]:
    """Save the three card relations as tables bucketed on the card id.

    Same bucket count and key on all three: per-card aggregates and the
    card/tag/review joins then read co-located buckets and need no exchange.
    Tables are external (their files live under ``path``, e.g. the shared
    folder); returns the table names.
    """
    names = {"cards": f"{prefix}_flashcards", "tags": f"{prefix}_flashcard_tags",
             "reviews": f"{prefix}_review_history"}
    (cards.write.mode("overwrite").bucketBy(buckets, "id").sortBy("id")
     .option("path", f"{path}/flashcards").saveAsTable(names["cards"]))
    (tags.write.mode("overwrite").bucketBy(buckets, "card_id").sortBy("card_id")
     .option("path", f"{path}/flashcard_tags").saveAsTable(names["tags"]))
    (reviews.write.mode("overwrite").bucketBy(buckets, "card_id").sortBy("card_id", "review_date")
     .option("path", f"{path}/review_history").saveAsTable(names["reviews"]))
    return names
