"""Plan properties that matter at scale: pushdown, pruning, co-location."""

import datetime as dt
import re

from pyspark.sql import functions as F

from recall.operators import cards as co
from recall.operators import mining as mi
from recall.operators import schedule as sc
from recall.operators import vocab as vo
from recall.schema import REVIEW, WORD
from recall.session import shared_dir
from recall.sources import fixtures as fx
from recall.sources import tables as tb
from tests.conftest import SF001


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tag_filter_and_columns_reach_the_scan(spark):
    root = shared_dir(spark, "store")
    fx.cards(spark, SF001).write.parquet(f"{root}/cards")
    fx.flashcard_tags(spark, SF001).write.parquet(f"{root}/tags")
    cards, tags = tb.scan_cards(spark, f"{root}/cards"), tb.scan_card_tags(spark, f"{root}/tags")
    plan = _plan(co.cards_by_tag(cards.select("id", "question"), tags, "spanish"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(tag,spanish\)", plan)
    assert re.search(r"ReadSchema: struct<id:bigint,question:string>", plan)


def test_language_filter_prunes_partitions(spark):
    root = shared_dir(spark, "vocab")
    tb.write_words(fx.words(spark, SF001), root)
    plan = _plan(tb.words_of_language(spark, root, "es"))
    assert re.search(r"PartitionFilters: \[[^\]]*\(lang#\d+ = es\)", plan)


def test_due_filter_reaches_the_scan(spark):
    root = shared_dir(spark, "by_due")
    cards = fx.cards(spark, SF001)
    tb.write_cards_by_due(cards, root, files=4)
    as_of = fx.ts(fx.DEFAULT_AS_OF)
    tags = fx.flashcard_tags(spark, SF001)
    got = co.cards_due(tb.scan_cards_by_due(spark, root), tags, as_of)
    plan = _plan(got)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(due_at,", plan)
    expected = co.cards_due(cards, tags, as_of)
    assert got.columns == expected.columns
    assert sorted(got.select("id").collect()) == sorted(expected.select("id").collect())


def test_equal_due_times_fill_several_files(spark):
    root = shared_dir(spark, "one_due_time")
    cards = fx.cards(spark, SF001).withColumn("last_reviewed", fx.ts("2024-01-01")).withColumn("review_after_secs", F.lit(1).cast("long"))
    tb.write_cards_by_due(cards, root, files=4)
    assert len(spark.read.parquet(root).inputFiles()) > 1


def _no_broadcast(spark, make):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        return _plan(make())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_new_words_take_no_sort_aggregate(spark):
    rows = spark.createDataFrame([("en", "a", "a", 1, 0, 0)], "lang string, word string, translation string, doc_id long, line_no int, word_no int")
    words = spark.createDataFrame([], WORD)
    plan = _no_broadcast(spark, lambda: vo.words_add_new(words, rows, ["doc_id", "line_no", "word_no"], fx.ts("2024-01-01")))
    assert "SortAggregate" not in plan


def test_no_line_text_in_the_word_join(spark):
    docs, words = fx.documents(spark, SF001), spark.createDataFrame([("en", "a", "", None)], WORD)
    plan = _no_broadcast(spark, lambda: mi.new_word_sentences(docs, words))
    final = plan.split("+- == Initial Plan ==")[0]
    joins = [line for line in final.splitlines() if "SortMergeJoin" in line]
    assert joins and "SortAggregate" not in final
    exchanges = [line for line in final.splitlines() if re.search(r"Exchange hashpartitioning\(lang#\d+, word#\d+", line)]
    assert exchanges and not any("line#" in line and "line_no" not in line for line in exchanges)


def test_state_shuffles_the_log_once(spark):
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), True)], REVIEW)
    plan = _plan(sc.schedule_state(log)).split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # the log by (card, day), then days by card


def test_applying_answers_shuffles_only_touched_history(spark):
    history, cards = fx.history_before_answers(spark, SF001), fx.cards(spark, SF001)
    rows, _, _ = sc.reviews_apply(history, fx.answers(spark, SF001), cards)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.index("LeftSemi", plan.index("LeftAnti")) > 0


def test_bucketed_store_joins_without_exchange(spark):
    names = tb.save_card_store(fx.cards(spark, SF001), fx.flashcard_tags(spark, SF001), fx.reviews(spark, SF001),
                               "t_store", shared_dir(spark, "bucketed"), buckets=8)
    cards, tags = spark.table(names["cards"]), spark.table(names["tags"])
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")  # force the shuffle-join path: it must still not shuffle
        plan = _plan(co.cards_all(cards, tags))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    per_card = _plan(sc.dedupe_reviews(spark.table(names["reviews"])).groupBy("card_id").count())
    assert "Exchange" not in per_card, per_card
