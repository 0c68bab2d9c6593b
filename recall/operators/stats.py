"""Review statistics, vocabulary counts and per-language text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.functions.text import LANGUAGE_CODES, month

# A corpus chunk joins at most this many card answers, so no row grows with the data.
CORPUS_CHUNK_CARDS = 64


def avg_reviews_per_month(reviews: DataFrame) -> DataFrame:
    """Average over (card, month) of the number of reviews; empty input -> null."""
    per = reviews.groupBy("card_id", month("review_date").alias("month")).agg(
        F.count(F.lit(1)).alias("reviews"))
    return per.agg(F.avg("reviews").alias("avg_reviews_per_month"))


def word_count(words: DataFrame) -> DataFrame:
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("n_words"))


def sentences_corpus(cards: DataFrame, tags: DataFrame, chunk_cards: int = CORPUS_CHUNK_CARDS) -> DataFrame:
    """Answers of the cards tagged with each language, newline-joined in id order.

    One row per (tag, chunk of ``chunk_cards`` consecutive card ids), never one
    string per language: a language's corpus grows with the data.
    """
    lang_tags = tags.where(F.col("tag").isin(*LANGUAGE_CODES)).withColumnRenamed("card_id", "id")
    rows = cards.select("id", "answer").join(lang_tags, "id", "inner")
    chunk = F.floor(F.col("id") / F.lit(chunk_cards)).cast("long")
    grouped = rows.groupBy("tag", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("id", "answer"))).alias("_items"))
    return grouped.select(
        "tag", "chunk", F.size("_items").alias("n_cards"),
        F.array_join(F.transform("_items", lambda x: x["answer"]), "\n").alias("corpus"))
