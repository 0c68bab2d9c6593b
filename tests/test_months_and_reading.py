"""Monthly review counts kept by a stream, and bounded rankings."""

import datetime as dt
import random

from pyspark.sql import functions as F

from recall.operators import mining as mi
from recall.operators import stats as st
from recall.operators.ordering import first_within
from recall.schema import REVIEW
from recall.session import shared_dir
from recall.streaming import reviews as rs
from recall.streaming.months import MonthCounts
from tests.test_files_and_stream import cards_of, run_batches
from tests.test_plans import _plan

DAY0 = dt.datetime(2023, 11, 20)


def _day(n):
    return DAY0 + dt.timedelta(days=n)


def _full(spark, rows):
    return st.avg_reviews_per_month(spark.createDataFrame(rows, REVIEW)).first()[0]


def test_averages_equal_the_full_recomputation_after_every_batch(spark):
    rng, months, before = random.Random(5), MonthCounts(shared_dir(spark, "months"), every=3), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    seen, want, at = [], [], 0
    for batch in range(20):
        # Batch 4 is empty; from batch 2 on some answers belong to earlier months.
        rows = [] if batch == 4 else [(rng.randrange(4), _day(7 * batch) + dt.timedelta(minutes=at + i), True) for i in range(rng.randrange(1, 9))]
        if batch >= 2 and batch != 4:
            rows += [(rng.randrange(6), _day(7 * rng.randrange(batch)) + dt.timedelta(hours=12, minutes=at), False)]
        at += 10
        seen += rows
        months.add(batch, spark.createDataFrame(rows, REVIEW))
        want.append(_full(spark, seen))
    got = {r.batch_id: r.avg_reviews_per_month for r in months.averages(spark).collect()}
    assert got == dict(enumerate(want))
    direct = spark.createDataFrame(seen, REVIEW).groupBy("card_id", (F.year("review_date") * 12 + F.month("review_date") - 1).alias("month")).count()
    assert sorted(tuple(r) for r in months.current(spark).collect()) == sorted(tuple(r) for r in direct.collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_batch_reads_the_runs_of_its_own_months(spark):
    months = MonthCounts(shared_dir(spark, "months"), every=4)
    for batch in range(3):
        months.add(batch, spark.createDataFrame([(1, _day(40 * batch), True), (2, _day(40 * batch), True)], REVIEW))
    wanted = 2023 * 12 + 11  # December
    rows = months.counts(spark, rs._runs(3, 4), [wanted])
    scans = [line for line in rows._jdf.queryExecution().toString().splitlines() if "FileScan" in line]
    assert scans and all("month#" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scans)
    assert {r.month for r in rows.collect()} == {wanted}


def test_a_batch_that_runs_again_changes_nothing(spark):
    months, rows = MonthCounts(shared_dir(spark, "months"), every=2), [[(1, _day(0), True)], [(1, _day(1), True), (2, None, True)], [(1, _day(2), False)]]
    for batch, new in enumerate(rows):
        months.add(batch, spark.createDataFrame(new, "card_id long, review_date timestamp_ntz, remembered boolean"))
    before = sorted(months.averages(spark).collect()), sorted(months.current(spark).collect())
    months.add(2, spark.createDataFrame(rows[2], REVIEW))
    assert before == (sorted(months.averages(spark).collect()), sorted(months.current(spark).collect()))
    assert [tuple(r) for r in before[0]] == [(0, 1, 1, 1.0), (1, 2, 3, 1.5), (2, 2, 4, 2.0)]  # all of card 1 in November


def test_the_stream_counts_late_answers_and_no_repeats(spark):
    batches = [[(1, _day(0), True), (1, _day(20), True), (9, _day(20), True)],
               [(1, _day(20), False), (1, _day(1), True), (2, _day(60), True)]]  # a repeat, a late one, a new pair
    months = MonthCounts(shared_dir(spark, "months"))
    run_batches(spark, batches, cards_of(spark, [1, 2]), months=months)
    got = sorted((r.batch_id, r.n_pairs, r.n_reviews) for r in months.averages(spark).collect())
    assert got == [(0, 2, 2), (1, 3, 4)]


def test_no_batch_no_average(spark):
    months = MonthCounts(shared_dir(spark, "months"))
    assert months.averages(spark).collect() == [] and months.current(spark).collect() == []
    months.add(0, spark.createDataFrame([], REVIEW))
    assert [tuple(r) for r in months.averages(spark).collect()] == [(0, 0, 0, None)]


def test_first_within_equals_a_window_and_cuts_before_each_shuffle(spark):
    rng = random.Random(1)
    rows = [(None if g == 3 else g, rng.randrange(50), i) for i, g in enumerate([0] * 600 + [1] * 40 + [2, 3, 3])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v int, id long").repartition(7)
    got = first_within(df, ["g"], [F.desc("v"), F.asc("id")], 5)
    want = []
    for g in (0, 1, 2, None):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:5]
        want += [(*r, i + 1) for i, r in enumerate(best)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert _plan(got).split("Initial Plan")[0].count("WindowGroupLimit") >= 3


def test_reading_list_ranks_by_known_share(spark):
    vocab = ["casa", "sol", "luna", "mar"]
    texts = {1: "casa sol luna", 2: "casa sol luna mar", 3: "casa sol perro", 4: "gato perro", 5: "casa", 6: "casa sol gato luna sol perro", 7: ""}
    docs = spark.createDataFrame([(i, "es", t) for i, t in texts.items()] + [(8, None, "casa sol")], "doc_id long, lang string, text string")
    words = spark.createDataFrame([("es", w) for w in vocab], "lang string, word string")
    got = mi.reading_list(mi.vocabulary_coverage(docs, words), k=4, min_tokens=2).collect()
    assert sorted((r["rank"], r.doc_id) for r in got if r.lang == "es") == [(1, 2), (2, 1), (3, 3), (4, 6)]
    # One unknown word (3) before two (6) at the same share.
    assert [(r["rank"], r.doc_id, r.n_unknown) for r in got if r.lang is None] == [(1, 8, 2)]
