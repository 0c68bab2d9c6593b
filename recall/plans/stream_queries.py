"""The review stream as registered queries.

The review log derived from ``events`` arrives in four batches of eight days. Some
rows come one batch late, and some answers name a card that does not exist. Each batch's files are
written, then the stream runs until it has taken them, so the batches are
the same on every run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recall.plans.oracle import due_sql, state_with_cards_sql, with_ctes
from recall.plans.queries import query
from recall.session import shared_dir
from recall.sources import fixtures as fx
from recall.streaming import reviews as rs
from recall.streaming.months import MonthCounts

BATCHES = 4
COMPACT_EVERY = 3  # four batches: one snapshot is written and read


def arriving(spark, sf):
    """(card_id, review_date, remembered, batch)."""
    r = fx.reviews(spark, sf)
    late = F.when((F.col("card_id") * 31 + F.second("review_date")) % 11 == 0, 1).otherwise(0)
    day = F.dayofmonth("review_date") - 1
    r = r.withColumn("batch", F.least(F.lit(BATCHES - 1), F.floor(day / 8).cast("int") + late))
    unknown = r.where(F.col("card_id") % 7 == 0).withColumn("card_id", -1 - F.col("card_id"))
    return r.unionByName(unknown)


def run_stream(spark, sf, months=None):
    src, paths, rows = shared_dir(spark, "review_source"), rs.ReviewStreamPaths.under(spark), arriving(spark, sf)
    for i in range(BATCHES):
        rows.where(F.col("batch") == i).drop("batch").write.mode("append").parquet(src)
        q = rs.stream_reviews(spark, src, fx.cards(spark, sf), paths, files_per_batch=None, compact_every=COMPACT_EVERY, months=months)
        q.awaitTermination()
    return paths


@query("stream_reviews", with_ctes(["dedup_reviews", "cards"], f"""
    , seen AS (SELECT * FROM cards WHERE id IN (SELECT card_id FROM dedup_reviews))
    SELECT card_id, last_reviewed, review_after_secs, streak, overflow FROM (
    {state_with_cards_sql('dedup_reviews', 'seen')}) s"""))
def q_stream_reviews(spark, sf):
    return rs.current_state(spark, run_stream(spark, sf))


@query("stream_due", with_ctes(["reviews", "cards"], f"""
    , arrived AS (
        SELECT r.*, least({BATCHES - 1}, CAST(floor((day(review_date) - 1) / 8) AS INTEGER)
                          + CASE WHEN (card_id * 31 + second(review_date)) % 11 = 0 THEN 1 ELSE 0 END) AS batch
        FROM reviews r WHERE card_id IN (SELECT id FROM cards))
    , batches AS (SELECT k, (SELECT max(review_date) FROM arrived WHERE batch <= k) AS as_of FROM range({BATCHES}) t(k))
    , fails AS (SELECT k, card_id, max(CASE WHEN NOT remembered THEN review_date END) AS last_fail,
                       max(review_date) AS last_review, count(*) AS n_reviews
                FROM batches JOIN arrived ON batch <= k GROUP BY k, card_id)
    , runs AS (SELECT f.k, f.card_id, any_value(f.last_fail) AS last_fail, any_value(f.last_review) AS last_review,
                      count(*) FILTER (WHERE a.remembered AND (f.last_fail IS NULL OR a.review_date > f.last_fail)) AS streak
               FROM fails f JOIN arrived a ON a.card_id = f.card_id AND a.batch <= f.k GROUP BY f.k, f.card_id)
    , states AS (SELECT b.k, b.as_of, c.id AS card_id, coalesce(r.last_review, c.last_reviewed) AS last_reviewed,
                        CASE WHEN r.card_id IS NULL THEN c.review_after_secs
                             ELSE (CASE WHEN r.last_fail IS NULL THEN c.review_after_secs ELSE 21600 END) << CAST(r.streak AS INTEGER) END AS secs
                 FROM batches b CROSS JOIN cards c LEFT JOIN runs r ON r.k = b.k AND r.card_id = c.id)
    SELECT min(k) AS batch_id, card_id, due_at, min(as_of) AS as_of
    FROM (SELECT *, {due_sql('last_reviewed', 'secs')} AS due_at FROM states) s
    WHERE due_at < as_of GROUP BY card_id, due_at"""))
def q_stream_due(spark, sf):
    return rs.stream_due(spark, run_stream(spark, sf))


@query("avg_reviews_per_month_stream", with_ctes(["reviews", "cards"], f"""
    , arrived AS (
        SELECT card_id, review_date,
               min(least({BATCHES - 1}, CAST(floor((day(review_date) - 1) / 8) AS INTEGER)
                   + CASE WHEN (card_id * 31 + second(review_date)) % 11 = 0 THEN 1 ELSE 0 END)) AS batch
        FROM reviews WHERE card_id IN (SELECT id FROM cards) GROUP BY card_id, review_date)
    , pairs AS (SELECT k, card_id, strftime(review_date, '%Y-%m') AS year_month, count(*) AS n
                FROM range({BATCHES}) t(k) JOIN arrived ON batch <= k GROUP BY k, card_id, year_month)
    SELECT k AS batch_id, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n_reviews, avg(n) AS avg_reviews_per_month
    FROM pairs GROUP BY k"""))
def q_avg_reviews_per_month_stream(spark, sf):
    months = MonthCounts(shared_dir(spark, "review_months"), COMPACT_EVERY)
    run_stream(spark, sf, months)
    return months.averages(spark)
