"""Empty inputs give empty (or null) results, never errors."""

from pyspark.sql import functions as F

from recall.operators import mining as mi
from recall.operators import schedule as sc
from recall.operators import stats as st
from recall.operators.ordering import rank_within
from recall.schema import CARD, CARD_TAG, REVIEW, WORD


def test_empty_inputs(spark):
    reviews = spark.createDataFrame([], REVIEW)
    cards = spark.createDataFrame([], CARD)
    tags = spark.createDataFrame([], CARD_TAG)
    words = spark.createDataFrame([], WORD)
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert sc.schedule_state(reviews).count() == 0
    assert sc.schedule_state(reviews, cards).count() == 0
    assert sc.schedule_trace(reviews).count() == 0
    assert sc.review_queue(cards, tags, F.lit("2024-01-01").cast("timestamp_ntz")).count() == 0
    assert rank_within(tags, ["tag"], ["card_id"]).count() == 0
    assert mi.new_word_sentences(docs, words).count() == 0
    assert mi.vocabulary_coverage(docs, words).count() == 0
    assert st.avg_reviews_per_month(reviews).collect()[0][0] is None
