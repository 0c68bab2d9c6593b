"""Helpers shared by the operators: stable row addresses, written tables, label folds."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.session import shared_dir

FOLDS = 5  # labels of fold 0 are never learnt from


def once_per_process(key: tuple, make: Callable[[], object]):
    """``make()``, kept in the Python worker between its tasks (functions arrive anew with each task)."""
    kept = vars(sys).setdefault("_recall_llm_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """``(at, doc)``: each row with its address ``at(file, row)``.

    The address is the Parquet file and the row's place in it: the same on every
    read, also for repeated rows and null ids. Input that does not come straight
    from Parquet files is written first. The row's own columns stay inside ``doc``, where
    no name can clash.
    """
    def address(df: DataFrame) -> DataFrame:
        return df.select(
            F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
            F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("doc"))
    try:
        return address(docs)
    except AnalysisException:
        return address(written(docs, "rows"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def label_sample(labels_df: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids ``(doc_id, label)`` outside fold 0: those with the smallest hashes.

    Null ids and labels are left out; of repeated ids the largest label counts. A first cut at twice the
    share that is wanted keeps the sort small; it holds the ``most`` smallest as hashes are evenly spread.
    """
    known = labels_df.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    one = one.withColumn("_u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32))
    n = one.count()
    return one.filter(F.col("_u") <= F.lit(2.0 * most / max(n, 1))).orderBy("_u", "doc_id").limit(most).drop("_u")


BLOCK_BYTES = 1 << 18


def text_views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text, in place (a null text is empty)."""
    for value in column:
        yield memoryview(value.as_buffer() or b"")


def word_blocks(text: memoryview, table: bytes | None = None, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in lists of about ``block`` bytes, mapped through ``table``.

    However long the text, little more than a block (or the longest word) is held at once.
    """
    begun: list[bytes] = []  # parts of a word that goes on
    for at in range(0, len(text), block):
        part = bytes(text[at:at + block])
        part = part.translate(table) if table else part
        words = part.split()
        if not words:
            if begun:
                yield [b"".join(begun)]
                begun = []
            continue
        open_, ended = not part[:1].isspace(), part[-1:].isspace()
        if begun:
            if open_:
                begun.append(words[0])
                if len(words) == 1 and not ended:
                    continue
                words[0] = b"".join(begun)
            else:
                words.insert(0, b"".join(begun))
            begun = []
        if not ended:
            begun.append(words.pop())
        if words:
            yield words
    if begun:
        yield [b"".join(begun)]
