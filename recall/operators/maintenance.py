"""Card maintenance as DataFrame jobs: add a batch of drafts, apply a batch of edits.

Parquet has no row update, so each job reads the old version and returns the
new one; the caller writes it as a new table version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.operators.ordering import rank_within
from recall.schema import CARD_COLUMNS, CONTENT_COLUMNS


def last_edits(edits: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """One edit per key: the last by ``order``, as sequential updates would leave it.

    Without ``order`` a key may only be repeated by equal rows: two different edits of a key fail the job.
    """
    if order is None:
        values = F.struct(*[c for c in edits.columns if c not in keys])
        one = edits.groupBy(*keys).agg(F.min(values).alias("_v"), F.max(values).alias("_w"))
        clash = F.raise_error(F.concat(F.lit("different edits of one key and no order: "), F.to_json(F.struct(*keys))))
        checked = one.withColumn("_v", F.when(F.col("_v").eqNullSafe(F.col("_w")), F.col("_v")).otherwise(clash))
        return checked.select(*keys, "_v.*")
    values = [c for c in edits.columns if c not in keys and c not in order]
    last = edits.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return last.select(*keys, "_v.*")


def cards_add(cards: DataFrame, drafts: DataFrame, order_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Assign ids ``max(id) + 1 ...`` to drafts in ``order_cols`` order; fan out their tags.

    Returns ``(new_cards, new_tags)`` to append. ``order_cols`` identify a draft: only they are
    numbered (range-partitioned ``rank_within``, no single-task global window), and
    the texts meet their number by one join; the current maximum id is a
    scalar subquery.
    """
    top = cards.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    ranked = rank_within(drafts.select(*order_cols), [], order_cols, total=None)
    ids = ranked.select(*order_cols, (top + F.col("position")).alias("id"))
    with_id = drafts.drop("id").join(ids, order_cols)
    new_cards = with_id.select(*CARD_COLUMNS, *[c for c in with_id.columns if c not in CARD_COLUMNS + ["tags"]])
    new_tags = with_id.select(F.col("id").alias("card_id"), F.posexplode("tags").alias("_pos", "tag"))
    return new_cards, new_tags


def cards_update(cards: DataFrame, tags: DataFrame, edits: DataFrame,
                 order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace the six content columns and the tag set of edited cards.

    Of several edits of a card the last by ``order`` counts. The schedule
    (last_reviewed, review_after_secs) is kept. A null in an edit is written as
    null. Edits of unknown ids change nothing.
    """
    edits = last_edits(edits, ["id"], order)
    e = edits.select("id", *[F.col(c).alias("_e_" + c) for c in CONTENT_COLUMNS], F.lit(True).alias("_edited"))
    j = cards.join(e, "id", "left")
    new_cards = j.select(*[
        F.when(F.col("_edited"), F.col("_e_" + c)).otherwise(F.col(c)).alias(c) if c in CONTENT_COLUMNS else c
        for c in CARD_COLUMNS])
    known_edits = edits.join(cards.select("id"), "id", "left_semi")
    kept = tags.join(known_edits.select(F.col("id").alias("card_id")), "card_id", "left_anti")
    fresh = known_edits.select(F.col("id").alias("card_id"), F.explode(F.array_distinct("tags")).alias("tag"))
    return new_cards, kept.unionByName(fresh)
