"""Tasks that gather words: their number follows the text, whatever the files and cores."""

import pytest
from pyspark.sql import functions as F

from recall.operators import mining as mi
from recall.schema import WORD
from recall.session import shared_dir
from recall.sources import fixtures as fx
from recall.sources import tables as tb
from tests.conftest import SF001

LIMIT = 20_000
NO_BROADCAST = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


def _text_of_partitions(df, text="text"):
    """(bytes, rows, largest text) of each partition that has rows."""
    n = F.octet_length(text)
    return [tuple(r)[1:] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(n), F.count(F.lit(1)), F.max(n)).collect()]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(tb, "TASK_TEXT_BYTES", LIMIT, raising=False)


@pytest.mark.parametrize("files", [1, 8])  # fewer files than cores, and more
def test_tasks_follow_the_text(spark, small_tasks, files):
    folder = shared_dir(spark, "few_or_many")
    tb.read_table(spark, SF001, "documents").repartition(files).write.parquet(f"{folder}/documents.parquet")
    docs = fx.documents(spark, folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert size > 16 * LIMIT  # more than the cores alone would give
    assert docs.rdd.getNumPartitions() == -(-size // LIMIT)
    parts = _text_of_partitions(docs)
    assert sum(p[1] for p in parts) == tb.read_table(spark, SF001, "documents").count()
    assert max(p[0] for p in parts) < size / 8  # no task has a share that the number of cores fixes
    assert sorted(fx.doc_word_counts(spark, folder).collect()) == sorted(
        mi.doc_word_counts(tb.read_table(spark, SF001, "documents", ["doc_id", "lang", "text"])).collect())


def test_cards_follow_their_text(spark, small_tasks):
    cards = tb.spread(fx.cards(spark, SF001), "id", "answer")
    size = fx.cards(spark, SF001).agg(F.sum(F.octet_length("answer"))).first()[0]
    assert cards.rdd.getNumPartitions() == -(-size // LIMIT)


def test_no_text_at_all(spark):
    docs = spark.createDataFrame([(1, "en", None)], "doc_id long, lang string, text string")
    least = 2 * spark.sparkContext.defaultParallelism
    for df in (docs, docs.limit(0)):
        assert tb.spread(df, "doc_id").rdd.getNumPartitions() == least


def test_words_of_documents_are_counted_where_the_texts_are(spark):
    plan = fx.doc_word_counts(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_streamed_tables_of_many_files_stay(spark, small_tasks):
    folder = shared_dir(spark, "many")
    tb.read_table(spark, SF001, "documents").repartition(8).write.parquet(f"{folder}/documents.parquet")
    assert "Exchange" not in fx.documents(spark, folder, streamed=True)._jdf.queryExecution().executedPlan().toString()


def test_coverage_sorts_no_counts(spark):
    counts = spark.createDataFrame([(1, "en", "a", 2), (1, "en", "b", 1), (2, None, "a", 1)], "doc_id long, lang string, word string, n long")
    words = spark.createDataFrame([("en", "a", "", None), ("en", "c", "", None)], WORD)
    old = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    try:
        for k in NO_BROADCAST:
            spark.conf.set(k, "-1")
        got = mi.coverage_from_counts(counts, words)
        rows = sorted(tuple(r)[:6] for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows == [(1, "en", 3, 2, 2, 1), (2, None, 1, 0, 1, 0)]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan, plan
