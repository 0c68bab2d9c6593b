"""Relations of the card store and the constants of the review schedule."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the review schedule (must equal the application) ---
FIRST_INTERVAL_SECS = 43200  # a new card waits 12 hours
FAIL_INTERVAL_SECS = 21600  # a forgotten card waits 6 hours
GROWTH_FACTOR = 2  # a remembered card doubles its interval
# --- fixed value: the stored source of generated cards ---
DRAFT_SOURCE = "learning-languages app"

CARD = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("question", T.StringType(), True),
        T.StructField("answer", T.StringType(), True),
        T.StructField("examples", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("img", T.StringType(), True),
        T.StructField("last_reviewed", T.TimestampNTZType(), True),
        T.StructField("review_after_secs", T.LongType(), True),
        T.StructField("question_img", T.StringType(), True),
    ]
)
CARD_COLUMNS = [f.name for f in CARD.fields]
CONTENT_COLUMNS = ["question", "answer", "examples", "source", "img", "question_img"]

CARD_TAG = T.StructType(
    [
        T.StructField("card_id", T.LongType(), False),
        T.StructField("tag", T.StringType(), False),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("card_id", T.LongType(), False),
        T.StructField("review_date", T.TimestampNTZType(), False),
        T.StructField("remembered", T.BooleanType(), False),
    ]
)

WORD = T.StructType(
    [
        T.StructField("lang", T.StringType(), False),
        T.StructField("word", T.StringType(), False),
        T.StructField("translation", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)

NEW_SENTENCE = T.StructType(
    [
        T.StructField("text", T.StringType(), True),
        T.StructField("new_word", T.StringType(), True),
        T.StructField("translation", T.StringType(), True),
    ]
)

TEXT_BLOCK = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("text", T.StringType(), True),
        ]
    )
)
