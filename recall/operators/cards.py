"""Card reads: the card ⋈ tag relation and its projections.

Tags are aggregated on the narrow bridge first and joined to the wide card
rows afterwards, so no aggregate ever groups by the card's text columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.functions.text import due_at, tags_parse
from recall.schema import CARD_COLUMNS, DRAFT_SOURCE, FIRST_INTERVAL_SECS


def tags_by_card(tags: DataFrame) -> DataFrame:
    """(card_id, tags): sorted, distinct tags of every card that has one.

    Partial aggregation de-duplicates map-side, so a card's group holds at
    most one entry per distinct tag of the store however many bridge rows it has.
    """
    return tags.groupBy("card_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def _assemble(cards: DataFrame, tag_groups: DataFrame) -> DataFrame:
    # Inner join: a card without any tag is not returned by any card read.
    return cards.join(tag_groups.withColumnRenamed("card_id", "id"), "id", "inner")


def cards_all(cards: DataFrame, tags: DataFrame) -> DataFrame:
    return _assemble(cards, tags_by_card(tags))


def cards_by_tag(cards: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Cards carrying ``tag``; their tag list holds that tag only (filter before group)."""
    return _assemble(cards, tags_by_card(tags.where(F.col("tag") == F.lit(tag))))


def card_by_id(cards: DataFrame, tags: DataFrame, card_id: int) -> DataFrame:
    """Point lookup; a missing or untagged card gives no row."""
    key = F.lit(card_id).cast("long")
    return _assemble(cards.where(F.col("id") == key), tags_by_card(tags.where(F.col("card_id") == key)))


def cards_due(cards: DataFrame, tags: DataFrame, as_of) -> DataFrame:
    """Cards whose ``last_reviewed + review_after_secs`` is strictly before ``as_of``.

    A stored ``due_at`` column (``write_cards_by_due``) is used when there is one: its filter
    reaches the scan, the two-column sum does not.
    """
    if "due_at" in cards.columns:
        due = cards.where(F.col("due_at") < as_of).drop("due_at")
    else:
        due = cards.where(due_at("last_reviewed", "review_after_secs") < as_of)
    return cards_all(due, tags)


def card_listing(assembled: DataFrame) -> DataFrame:
    """List view: tags joined by ', ', last review as minutes."""
    return assembled.select(
        "id", "question", "answer",
        F.array_join("tags", ", ").alias("tags"),
        F.date_format("last_reviewed", "yyyy-MM-dd HH:mm").alias("last_reviewed"),
    )


def card_media_links(cards: DataFrame) -> DataFrame:
    """Media paths of both image columns; a missing image stays null."""
    return cards.select(
        "id",
        F.concat(F.lit("/media/"), F.col("img")).alias("img_link"),
        F.concat(F.lit("/media/"), F.col("question_img")).alias("question_img_link"),
    )


def card_count(cards: DataFrame, tags: DataFrame) -> DataFrame:
    """Number of cards visible in the list (tagged cards only)."""
    visible = cards.select("id").join(tags.select(F.col("card_id").alias("id")), "id", "left_semi")
    return visible.agg(F.count(F.lit(1)).alias("n_cards"))


def card_drafts(forms: DataFrame, as_of) -> DataFrame:
    """New-card rows from entered form fields (id 0 until ``cards_add`` assigns one)."""
    return forms.select(
        F.lit(0).cast("long").alias("id"),
        "question", "answer",
        F.coalesce(F.col("examples"), F.lit("")).alias("examples"),
        "source", "img",
        as_of.alias("last_reviewed"),
        F.lit(FIRST_INTERVAL_SECS).cast("long").alias("review_after_secs"),
        "question_img",
        tags_parse("tags_text").alias("tags"),
        *[c for c in forms.columns if c not in CARD_COLUMNS and c not in ("tags_text",)],
    )


def drafts_from_sentences(sentences: DataFrame, as_of, from_story: bool = False) -> DataFrame:
    """Card drafts from sentences of a language.

    Generated sentence: answer = sentence, question = ''. Story sentence:
    question = its translation, answer = sentence. The tag is the language.
    """
    question = F.col("translation") if from_story else F.lit("")
    return sentences.select(
        F.lit(0).cast("long").alias("id"),
        question.alias("question"),
        F.col("text").alias("answer"),
        F.lit("").alias("examples"),
        F.lit(DRAFT_SOURCE).alias("source"),
        F.lit(None).cast("string").alias("img"),
        as_of.alias("last_reviewed"),
        F.lit(FIRST_INTERVAL_SECS).cast("long").alias("review_after_secs"),
        F.lit(None).cast("string").alias("question_img"),
        F.array(F.col("language")).alias("tags"),
        *[c for c in sentences.columns if c not in ("text", "translation", "language")],
    )


def mark_known(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Add ``status`` = accepted / quarantined by whether ``on`` exists in ``keys``.

    One left join against the distinct keys does both the semi and the anti split.
    """
    known = keys.select(on).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), F.lit("quarantined")).otherwise(F.lit("accepted"))
    return rows.join(known, on, "left").withColumn("status", status).drop("_known")


def accepted(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on), on, "left_semi")


def quarantined(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on), on, "left_anti")


def reviews_quarantine(reviews: DataFrame, cards: DataFrame) -> DataFrame:
    """Review rows with ``status``: quarantined when the card does not exist."""
    return mark_known(reviews, cards.select(F.col("id").alias("card_id")), "card_id")


def tags_quarantine(tags: DataFrame, cards: DataFrame) -> DataFrame:
    """Bridge rows with ``status``: quarantined when the card does not exist."""
    return mark_known(tags, cards.select(F.col("id").alias("card_id")), "card_id")
