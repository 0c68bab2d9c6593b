"""Review schedule derived from the append-only review history.

The application mutates ``(last_reviewed, review_after_secs)`` on every answer:
remembered doubles the interval, forgotten resets it to 6 hours. Folding that
over a card's history has a closed form:

    last_fail = max(ts where not remembered)
    streak    = #successes after last_fail (all of them if none)
    secs      = (last_fail is null ? base : 21600) * 2 ** streak
    last      = max(ts)

so the state is an aggregate of the log: order-insensitive input, idempotent,
correct for late data, and no row update is needed on Parquet. Doubling is
exact; an interval that a long cannot hold is null with ``overflow`` set.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.functions.text import due_at, interval_after, interval_overflows
from recall.operators.cards import accepted
from recall.operators.ordering import range_partitions, rank_within
from recall.schema import FIRST_INTERVAL_SECS
from recall.session import ensure_checkpoint_dir
from recall.sources.tables import materialize

# The per-partition scan below runs in Python workers; ship it by value so
# executors need numpy/pandas only, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dedupe_reviews(reviews: DataFrame) -> DataFrame:
    """One row per (card_id, review_date); a repeated pair keeps the failure."""
    return reviews.groupBy("card_id", "review_date").agg(F.bool_and("remembered").alias("remembered"))


def replay(reviews: DataFrame) -> DataFrame:
    """Per card: last_fail, last_review, n_reviews, streak (successes after last_fail).

    The log is shuffled once, on (card, day): there it is de-duplicated and each
    card's day becomes one row (its last failure, the successes after it, all its
    successes). These rows are folded per card, last day first. A hot card's
    history is spread over its days; no task holds more than one day of it,
    then one short row per day.
    """
    day = F.to_date("review_date").alias("_day")
    log = reviews.select("card_id", "review_date", "remembered", day).repartition("card_id", "_day")
    log = log.groupBy("card_id", "_day", "review_date").agg(F.bool_and("remembered").alias("remembered"))
    of_day = Window.partitionBy("card_id", "_day")
    log = log.withColumn("_fail", F.max(F.when(~F.col("remembered"), F.col("review_date"))).over(of_day))
    after = F.col("remembered") & (F.col("_fail").isNull() | (F.col("review_date") > F.col("_fail")))
    days = log.groupBy("card_id", "_day").agg(
        F.max("_fail").alias("last_fail"), F.max("review_date").alias("last_review"),
        F.count(F.lit(1)).alias("n_reviews"), F.count(F.when(after, 1)).alias("_run"))
    # A day's run counts if no later day has a failure.
    later = Window.partitionBy("card_id").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_cut", F.coalesce(F.max(F.col("last_fail").isNotNull()).over(later), F.lit(False)))
    return days.groupBy("card_id").agg(
        F.max("last_fail").alias("last_fail"), F.max("last_review").alias("last_review"),
        F.sum("n_reviews").alias("n_reviews"), F.sum(F.when(~F.col("_cut"), F.col("_run")).otherwise(0)).alias("streak"))


def schedule_state(reviews: DataFrame, cards: DataFrame | None = None,
                   base_secs: int = FIRST_INTERVAL_SECS) -> DataFrame:
    """Current (last_reviewed, review_after_secs) of every card.

    Without ``cards``: one row per reviewed card, starting from ``base_secs``.
    With ``cards``: one row per card; its stored interval is the start value
    and a card without history keeps its stored state.
    """
    s = replay(reviews)
    failed = F.col("last_fail").isNotNull()
    if cards is None:
        return s.select(
            "card_id",
            F.col("last_review").alias("last_reviewed"),
            interval_after(F.lit(base_secs), failed, F.col("streak")).alias("review_after_secs"),
            "n_reviews", "streak", interval_overflows(F.lit(base_secs), failed, F.col("streak")).alias("overflow"),
        )
    stored = cards.select(F.col("id").alias("card_id"), F.col("last_reviewed").alias("_lr"),
                          F.col("review_after_secs").alias("_secs"))
    j = stored.join(s, "card_id", "left")
    return j.select(
        "card_id",
        F.coalesce("last_review", "_lr").alias("last_reviewed"),
        F.when(F.col("n_reviews").isNull(), F.col("_secs"))
        .otherwise(interval_after(F.col("_secs"), failed, F.col("streak"))).alias("review_after_secs"),
        F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"),
        F.coalesce("streak", F.lit(0)).alias("streak"),
        (F.col("n_reviews").isNotNull() & interval_overflows(F.col("_secs"), failed, F.col("streak"))).alias("overflow"),
    )


# --- per-review trace ----------------------------------------------------------

_LOCAL = T.StructType([
    T.StructField("card_id", T.LongType()),
    T.StructField("review_date", T.TimestampNTZType()),
    T.StructField("remembered", T.BooleanType()),
    T.StructField("base_secs", T.LongType()),
    T.StructField("_failed", T.BooleanType()),
    T.StructField("streak", T.LongType()),
])
_EDGE = "part int, first_card long, last_card long, last_fails long, last_streak long"


def _runs(batches, start):
    """(pdf, failures so far, successes since the last failure) per batch of sorted rows.

    Counts restart with each card; ``start`` = (card, failures, streak) continues that card.
    """
    prev_card, prev_fails, prev_streak = start
    for pdf in batches:
        if pdf.empty:
            continue
        card = pdf["card_id"].to_numpy()
        rem = pdf["remembered"].to_numpy(dtype=bool)
        new = np.empty(len(card), dtype=bool)
        new[0] = card[0] != prev_card
        new[1:] = card[1:] != card[:-1]
        gid = np.cumsum(new)
        cont = gid == 0  # rows that continue the previous batch's card
        frame = pd.DataFrame({"g": gid, "f": (~rem).astype(np.int64), "r": rem.astype(np.int64)})
        fails = frame.groupby("g")["f"].cumsum().to_numpy() + np.where(cont, prev_fails, 0)
        frame["s"] = fails
        streak = frame.groupby(["g", "s"])["r"].cumsum().to_numpy()
        streak = streak + np.where(cont & (fails == prev_fails), prev_streak, 0)
        prev_card, prev_fails, prev_streak = card[-1], int(fails[-1]), int(streak[-1])
        yield pdf, fails, streak


def _edge(batches):
    """One row for the partition: its first card, and the run that its last card ends with."""
    first = None
    for pdf, fails, streak in _runs(batches, (None, 0, 0)):
        first = pdf["card_id"].iloc[0] if first is None else first
        last = (pdf["card_id"].iloc[-1], fails[-1], streak[-1])
    if first is not None:
        yield pd.DataFrame([(TaskContext.get().partitionId(), first, *last)],
                           columns=["part", "first_card", "last_card", "last_fails", "last_streak"])


def _carries(edges):
    """Per partition: (card, failures, streak) with which its first card comes in, from rows in partition order."""
    out, state = {}, (None, 0, 0)
    for e in edges:
        out[e.part] = state if state[0] == e.first_card else (None, 0, 0)
        card, fails, streak = out[e.part]
        if e.first_card == e.last_card and card == e.last_card:
            state = (card, fails + e.last_fails, e.last_streak if e.last_fails else streak + e.last_streak)
        else:
            state = (e.last_card, e.last_fails, e.last_streak)
    return out


def schedule_trace(reviews: DataFrame, base_secs: int | None = FIRST_INTERVAL_SECS,
                   num_partitions: int | None = None) -> DataFrame:
    """The state each answer produced: interval after it, next due time, streak.

    ``reviews`` may carry a per-card ``base_secs`` column; else ``base_secs``
    applies. A running scan per card is a prefix sum: rows are range-partitioned
    on (card, time) so a hot card spans many tasks. One pass over the sorted
    partitions gives a row per partition (how its last card's run ends); these
    few rows, one per task, are folded on the driver into what each partition's first
    card brings along; a second pass emits the rows.
    """
    if "base_secs" not in reviews.columns:
        reviews = reviews.withColumn("base_secs", F.lit(base_secs).cast("long"))
    base = reviews.groupBy("card_id", "review_date").agg(
        F.bool_and("remembered").alias("remembered"), F.max("base_secs").alias("base_secs"))
    if not num_partitions:
        base = materialize(base, "reviews_to_trace")  # counting, sampling and shuffling would each aggregate anew
    n = num_partitions or range_partitions(base)
    # Both passes must see identical partitions, and range bounds are sampled
    # from shuffle output whose order is not fixed: cut the partitioned log into
    # a reliable checkpoint (shared storage).
    ensure_checkpoint_dir(reviews.sparkSession)
    ranged = (base.repartitionByRange(n, "card_id", "review_date")
              .sortWithinPartitions("card_id", "review_date").checkpoint(eager=True))
    carries = _carries(ranged.select("card_id", "remembered").mapInPandas(_edge, _EDGE).orderBy("part").collect())

    def scan(batches):
        start = carries.get(TaskContext.get().partitionId(), (None, 0, 0))
        for pdf, fails, streak in _runs(batches, start):
            yield pdf.assign(_failed=fails > 0, streak=streak)

    t = ranged.mapInPandas(scan, _LOCAL)
    secs = interval_after(F.col("base_secs"), F.col("_failed"), F.col("streak"))
    return t.select(
        "card_id", "review_date", "remembered",
        secs.alias("review_after_secs"),
        due_at("review_date", secs).alias("next_due"),
        "streak", interval_overflows(F.col("base_secs"), F.col("_failed"), F.col("streak")).alias("overflow"),
    )


# --- answers ---------------------------------------------------------------------

ANSWER_YES, ANSWER_NO = "y", "n"  # fixed values: the console's answer letters


def answers_to_reviews(answers: DataFrame) -> DataFrame:
    """'y' = remembered, 'n' = forgotten; any other answer changes nothing."""
    a = answers.where(F.col("answer").isin(ANSWER_YES, ANSWER_NO))
    return a.select("card_id", F.col("answered_at").alias("review_date"),
                    (F.col("answer") == F.lit(ANSWER_YES)).alias("remembered"))


def answers_quarantine(answers: DataFrame, cards: DataFrame) -> DataFrame:
    """Answers ``reviews_apply`` does not apply, with the reason.

    ``unknown_card``: the card does not exist (a foreign-key violation in the
    application); ``no_change``: the answer is neither 'y' nor 'n'.
    """
    known = cards.select(F.col("id").alias("card_id")).distinct().withColumn("_known", F.lit(True))
    j = answers.join(known, "card_id", "left")
    reason = (F.when(F.col("_known").isNull(), F.lit("unknown_card"))
              .when(~F.col("answer").isin(ANSWER_YES, ANSWER_NO) | F.col("answer").isNull(), F.lit("no_change")))
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_known")


def reviews_apply(history: DataFrame, answers: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a batch of answers to the append-only history.

    Returns ``(rows, state, rejected)``: the rows to append (known cards only, one
    per (card, time), none that the history already has), the schedule of the
    cards they touch, and the answers that change nothing, with the reason. The
    history is only read for the touched cards.
    """
    known = accepted(answers_to_reviews(answers), cards.select(F.col("id").alias("card_id")), "card_id")
    batch = dedupe_reviews(known)
    touched = batch.select("card_id").distinct()
    past = history.join(touched, "card_id", "left_semi")
    rows = batch.join(past.select("card_id", "review_date"), ["card_id", "review_date"], "left_anti")
    new_cards = cards.join(touched.withColumnRenamed("card_id", "id"), "id", "left_semi")
    state = schedule_state(past.select("card_id", "review_date", "remembered").unionByName(rows), new_cards)
    return rows, state, answers_quarantine(answers, cards)


def review_queue(cards: DataFrame, tags: DataFrame, as_of) -> DataFrame:
    """Per tag: the due cards in review order (due time, id) with position and total."""
    due = cards.select("id", due_at("last_reviewed", "review_after_secs").alias("due_at")).where(
        F.col("due_at") < as_of)
    per_tag = due.join(tags.withColumnRenamed("card_id", "id"), "id", "inner")
    # As a table: its rows are counted by the files' footers, and the join is made once.
    return rank_within(materialize(per_tag, "due_by_tag"), ["tag"], ["due_at", "id"], position="position", total="total")
