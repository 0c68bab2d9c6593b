"""Tables in hash-bucket folders: point reads, and edits that rewrite only what they touch.

A table's rows lie in folders ``[<column>=.../]bucket=b``, ``b`` a hash of its key modulo ``buckets``, each
folder's rows sorted by the key, with a Parquet Bloom filter on it. A look-up of a key computes its bucket, so the reader
prunes all other folders by their names, and of the bucket's files it skips every row group whose
statistics or Bloom filter rule the key out.

An edit finds the folders that its keys are in, reads these alone, writes their new version as a work table
and then puts it in place by dynamic partition overwrite. All other files keep their
names. The step that replaces folders reads the work table only, so a job that is cut off can do it again.
One writer at a time: readers during the replacement may see a folder before or after it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.operators.cards import cards_all
from recall.operators.maintenance import cards_update, last_edits
from recall.operators.vocab import words_delete, words_update
from recall.schema import CARD, CARD_TAG, WORD
from recall.sources.tables import materialize

BUCKETS = 256


@dataclass(frozen=True)
class BucketTable:
    """Where a table lies and how: ``keys`` are hashed into ``buckets``, below one folder per value of ``by``."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    buckets: int = BUCKETS
    options: dict = field(default_factory=dict)

    def bucket(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    @property
    def folders(self) -> list[str]:
        return [*self.by, "bucket"]

    def write(self, df: DataFrame, mode: str = "overwrite", dynamic: bool = False) -> None:
        """Few files a folder (a large folder gets more), each sorted by the key, with its Bloom filters."""
        rows = df.select(*self.schema.names).withColumn("bucket", self.bucket())
        writer = rows.hint("rebalance", *self.folders).sortWithinPartitions(*self.folders, *self.keys).write.mode(mode)
        for key in self.keys:
            if key not in self.by:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        for name, value in self.options.items():
            writer = writer.option(name, value)
        if dynamic:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*self.folders).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with ``bucket``."""
        fields = [T.StructField(f.name, f.dataType) for f in self.schema.fields]
        return spark.read.schema(T.StructType([*fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def rows_of(self, spark: SparkSession, **key) -> DataFrame:
        """The rows with one key: its folder is computed from the key, all others are pruned."""
        types = {f.name: f.dataType for f in self.schema.fields}
        values = {k: F.lit(v).cast(types[k]) for k, v in key.items()}
        rows = self.read(spark).where(F.col("bucket") == self.bucket(*[values[k] for k in self.keys]))
        for k, v in values.items():
            rows = rows.where(F.col(k) == v)
        return rows.drop("bucket")

    def touched(self, keys: DataFrame) -> list:
        """The folders that some keys are in: as many as the table has, at most."""
        return keys.select(*self.by, self.bucket().alias("bucket")).distinct().collect()

    def rows_in(self, spark: SparkSession, folders: list) -> DataFrame:
        """The rows of some folders; the filter prunes all others."""
        rows = self.read(spark)
        if not folders:
            return rows.limit(0)
        if not self.by:
            return rows.where(F.col("bucket").isin([f["bucket"] for f in folders]))
        buckets_of: dict[tuple, list[int]] = {}
        for f in folders:
            buckets_of.setdefault(tuple(f[c] for c in self.by), []).append(f["bucket"])
        wanted = F.lit(False)
        for values, buckets in buckets_of.items():
            here = F.col("bucket").isin(buckets)
            for c, v in zip(self.by, values):
                here = here & (F.col(c) == F.lit(v))
            wanted = wanted | here
        return rows.where(wanted)

    def replace(self, spark: SparkSession, folders: list, rows: DataFrame) -> None:
        """``rows`` are the new version of some folders; a folder left without rows is deleted."""
        if not folders:
            return
        new = materialize(rows.select(*self.schema.names), "edited_folders")
        left = {tuple(r) for r in new.select(*self.by, self.bucket()).distinct().collect()}
        self.write(new, dynamic=True)
        for f in folders:
            if tuple(f) not in left:
                path = "/".join([self.path, *[f"{c}={f[c]}" for c in self.folders]])
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class CardStore:
    """Cards by id and their tags by card id, in the same buckets."""

    def __init__(self, path: str, buckets: int = BUCKETS, options: dict | None = None):
        self.cards = BucketTable(f"{path}/cards", CARD, ("id",), (), buckets, options or {})
        self.tags = BucketTable(f"{path}/tags", CARD_TAG, ("card_id",), (), buckets, options or {})

    def save(self, cards: DataFrame, tags: DataFrame) -> None:
        self.cards.write(cards)
        self.tags.write(tags)

    def card_by_id(self, spark: SparkSession, card_id: int) -> DataFrame:
        """One card with its tags, from one folder of each table. A card without tags is not returned, as in the app."""
        return cards_all(self.cards.rows_of(spark, id=card_id), self.tags.rows_of(spark, card_id=card_id))

    def update(self, edits: DataFrame, order: list[str] | None = None) -> None:
        """``cards_update`` on the folders of the edited cards; the others are neither read nor written."""
        spark = edits.sparkSession
        folders = self.cards.touched(edits.select("id"))
        cards = self.cards.rows_in(spark, folders).drop("bucket")
        tags = self.tags.rows_in(spark, folders).drop("bucket")
        new_cards, new_tags = cards_update(cards, tags, materialize(last_edits(edits, ["id"], order), "card_edits"))
        new_cards = materialize(new_cards, "edited_cards")
        new_tags = materialize(new_tags, "edited_tags")  # both are read off the old version before any folder is replaced
        self.cards.replace(spark, folders, new_cards)
        self.tags.replace(spark, folders, new_tags)


class WordStore:
    """Vocabularies: a folder per language, buckets of words below."""

    def __init__(self, path: str, buckets: int = BUCKETS, options: dict | None = None):
        self.words = BucketTable(path, WORD, ("lang", "word"), ("lang",), buckets, options or {})

    def save(self, words: DataFrame) -> None:
        self.words.write(words)

    def all(self, spark: SparkSession) -> DataFrame:
        return self.words.read(spark).select(*WORD.names)

    def word(self, spark: SparkSession, lang: str, word: str) -> DataFrame:
        return self.words.rows_of(spark, lang=lang, word=word).select(*WORD.names)

    def update(self, edits: DataFrame, order: list[str] | None = None) -> None:
        """``words_update`` on the folders of the edited words."""
        spark = edits.sparkSession
        edits = materialize(last_edits(edits, ["lang", "word"], order), "word_edits")
        folders = self._present(spark, self.words.touched(edits))
        self.words.replace(spark, folders, words_update(self.words.rows_in(spark, folders), edits))

    def delete(self, keys: DataFrame) -> None:
        """``words_delete`` on the folders of the deleted words."""
        spark = keys.sparkSession
        folders = self._present(spark, self.words.touched(keys))
        self.words.replace(spark, folders, words_delete(self.words.rows_in(spark, folders), keys))

    def _present(self, spark: SparkSession, folders: list) -> list:
        """The folders that exist: an edit of an unknown language or word may name others. Only folder names are read."""
        here = {tuple(r) for r in self.words.read(spark).select("lang", "bucket").distinct().collect()}
        return [f for f in folders if tuple(f) in here]
