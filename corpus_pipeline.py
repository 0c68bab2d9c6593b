"""The corpus pipeline: toxicity, quality rules, exact and near duplicates, packing.

Each stage takes the documents that its predecessor kept, as a Parquet table read anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recall.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from recall.llm.rows import documents, labels, written

TOKENIZER = "byte_bpe_50k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5."""
    return toxicity.drop_toxic(docs, labels(spark, sf_dir), threshold=0.5)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines."""
    return quality_rules.drop_low_quality(docs, labels(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 4-word shingles, up to 4 differing bits."""
    return simhash.drop_near_duplicates(docs, words_per_shingle=4, most=4)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 1024-token sequences."""
    import public_tokenizers

    return packing.digests(packing.pieces(docs, public_tokenizers.path(TOKENIZER), 1024))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_rules_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the learnt stages and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "pipeline")
    return docs
