"""Card-store relations derived from the shared test tables.

Every derivation is a projection (plus one aggregate) of a given table, so the
work grows with the input. The same derivations exist as SQL in
``recall.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.schema import FIRST_INTERVAL_SECS
from recall.sources.tables import materialize, read_table, spread

# --- fixed values of the fixtures ---
DOC_LANGUAGE_NAMES = {"es": "spanish", "fr": "french", "de": "german", "en": "english"}
CARD_EPOCH = "2024-01-01"
DEFAULT_AS_OF = "2024-01-20 00:00:00"
ANSWERS_FROM = "2024-01-30 00:00:00"  # answers = the last day of review events
REMEMBERED_EVENTS = ("view", "click", "purchase")
VOCABULARY_MIN_DOCS = 10


def ts(value: str):
    """A ``timestamp_ntz`` literal."""
    return F.lit(value).cast("timestamp_ntz")


def _lang_name(c):
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(DOC_LANGUAGE_NAMES.items())])
    return F.element_at(m, c)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    doc = F.col("doc_id")
    return d.select(
        doc.alias("id"),
        F.substring_index("text", "\n", 1).alias("question"),
        F.col("text").alias("answer"),
        F.when(doc % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("")).alias("examples"),
        F.col("source"),
        F.when(doc % 5 == 0, F.concat(F.lit("doc_"), doc.cast("string"), F.lit(".png"))).alias("img"),
        F.date_add(F.lit(CARD_EPOCH).cast("date"), (doc % 30).cast("int")).cast("timestamp_ntz").alias(
            "last_reviewed"),
        F.call_function("shiftleft", F.lit(FIRST_INTERVAL_SECS).cast("long"), (doc % 6).cast("int")).alias(
            "review_after_secs"),
        F.when(doc % 7 == 0, F.concat(F.lit("q_"), doc.cast("string"), F.lit(".png"))).alias("question_img"),
    )


def flashcard_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    doc = F.col("doc_id")
    candidates = F.array(
        _lang_name(F.col("lang")),
        F.col("source"),
        F.when(doc % 10 == 3, F.lit("a,b")),
        F.when(doc % 10 == 4, F.lit("")),
    )
    tags = F.array_distinct(F.filter(candidates, lambda t: t.isNotNull()))
    return d.where(doc % 10 != 9).select(doc.alias("card_id"), F.explode(tags).alias("tag"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type"])
    return e.select(
        F.col("user_id").alias("card_id"),
        F.col("ts").alias("review_date"),
        F.col("event_type").isin(*REMEMBERED_EVENTS).alias("remembered"),
    )


def reviews_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review log from line items; a repeated (card, day) keeps the failure."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_shipdate", "l_returnflag"])
    return li.groupBy(F.col("l_partkey").alias("card_id"), F.col("l_shipdate").alias("review_date")).agg(
        F.bool_and(F.col("l_returnflag") != F.lit("R")).alias("remembered"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's events as answers, some again with the other answer, some again for an unknown card.

    Every third user's answers are repeated at the same time (a repeated pair keeps the failure),
    every fourth user's under a card id that no document has, every fifth user's at the user's
    first event of the month, which the history already holds.
    """
    e = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type"])
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    last_day = e.where(F.col("ts") >= ts(ANSWERS_FROM)).join(first, "user_id")
    answer = (F.when(F.col("event_type").isin(*REMEMBERED_EVENTS), F.lit("y"))
              .when(F.col("event_type") == F.lit("error"), F.lit("n")).otherwise(F.lit("?")))
    user = F.col("user_id")

    def row(card, at, given):
        return F.struct(card.alias("card_id"), at.alias("answered_at"), given.alias("answer"))

    rows = F.array(row(user, F.col("ts"), answer),
                   F.when(user % 3 == 0, row(user, F.col("ts"), F.lit("n"))),
                   F.when(user % 4 == 0, row(-1 - user, F.col("ts"), answer)),
                   F.when(user % 5 == 0, row(user, F.col("first_ts"), F.lit("n"))))
    return last_day.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def history_before_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).where(F.col("review_date") < ts(ANSWERS_FROM))


def documents(spark: SparkSession, sf_dir: str, columns=("doc_id", "lang", "text"), streamed: bool = False) -> DataFrame:
    """The corpus, spread on doc_id by the size of its texts (``streamed``: only when the scan is under-partitioned)."""
    return spread(read_table(spark, sf_dir, "documents", list(columns)), "doc_id", streamed=streamed)


def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, word, n); the one corpus pass every word table below reuses."""
    from recall.operators.mining import doc_word_counts as counts
    return counts(documents(spark, sf_dir))


def word_stats(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """(lang, word, n_occurrences, n_docs) over the whole corpus, as a work table.

    Vocabulary, dictionary and token tables all derive from it, often inside
    one job; it is computed once.
    """
    counts = counts if counts is not None else doc_word_counts(spark, sf_dir)
    stats = counts.groupBy("lang", "word").agg(
        F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_docs"))
    return materialize(stats, "word_stats")


def words(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """Vocabulary: words found in at least ten documents of their language."""
    stats = stats if stats is not None else word_stats(spark, sf_dir)
    frequent = stats.where(F.col("n_docs") >= VOCABULARY_MIN_DOCS)
    n = F.length("word") % 3
    return frequent.select(
        "lang", "word",
        F.when(n == 0, F.lit(None).cast("string")).when(n == 1, F.lit("")).otherwise(F.reverse("word")).alias(
            "translation"),
        F.lit(CARD_EPOCH).cast("timestamp_ntz").alias("created_at"),
    )


def dictionary(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """Second translation source: every even-length word, translated as ``lang:word``."""
    stats = stats if stats is not None else word_stats(spark, sf_dir)
    w = stats.where(F.length("word") % 2 == 0)
    return w.select("lang", "word", F.concat("lang", F.lit(":"), "word").alias("translation"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    return p.select("page_id", F.col("html").alias("body"))


def word_list_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    body = F.concat(F.lit("Here:\n<words>\n"), F.regexp_replace("text", " ", "\n"), F.lit("\n</words>"))
    return b.select("item_id", body.alias("body"))


def rich_text_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shapes of inline math around whole document texts (which have no backticks)."""
    d = documents(spark, sf_dir, ("doc_id", "text", "n_chars"), streamed=True)
    doc = F.col("doc_id")
    body = F.col("text")
    x = F.concat(F.col("n_chars").cast("string"), F.lit("/"), (doc + 1).cast("string"))
    case = doc % 6
    shaped = (
        F.when(case == 0, F.concat(body, F.lit(" "), x))
        .when(case == 1, F.concat(body, F.lit(" What is `math "), x, F.lit("` ?")))
        .when(case == 2, F.concat(F.lit("`math "), x, F.lit("` "), body))
        .when(case == 3, F.concat(body, F.lit(" a `math "), x))
        .when(case == 4, F.concat(body, F.lit(" a ``math "), x, F.lit("`")))
        .otherwise(F.concat(F.lit("`math ` "), body, F.lit(" `math "), x, F.lit("`")))
    )
    return d.select(doc, shaped.alias("text"))


def card_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every twentieth card, in order ``edit_no``; every fortieth is edited twice.

    New question, examples set to a real null, new tags; a second edit changes the question again.
    """
    c = cards(spark, sf_dir).where(F.col("id") % 20 == 0)
    times = F.when(F.col("id") % 40 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return c.select(
        "id", F.explode(times).alias("edit_no"),
        "question", "answer",
        F.lit(None).cast("string").alias("examples"),
        "source", "img", "question_img",
    ).withColumn("question", F.concat(F.lit("edited "), F.col("edit_no").cast("string"), F.lit(": "), F.col("question"))).withColumn(
        "tags", F.array(F.concat(F.lit("edited"), F.col("edit_no").cast("string")), F.col("source")))


def card_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form submissions: one per benchmark item."""
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return b.select(
        "item_id",
        F.substring_index("text", "\n", 1).alias("question"),
        F.col("text").alias("answer"),
        F.lit("").alias("examples"),
        F.lit("benchmark").alias("source"),
        F.concat(F.lit(" benchmark, "), F.substring_index("text", " ", 1), F.lit(" ,benchmark")).alias("tags_text"),
        F.lit(None).cast("string").alias("img"),
        F.lit(None).cast("string").alias("question_img"),
    )


def imported_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge rows imported from the parts catalogue: (part key as card id, brand)."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    return p.select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("tag"))


def word_edits(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """Edits of the dictionary's words in order ``edit_no``: each word once, long words twice."""
    d = dictionary(spark, sf_dir, stats)
    times = F.when(F.length("word") > 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("lang", "word", "translation", F.explode(times).alias("edit_no")).withColumn(
        "translation", F.concat("translation", F.lit("/"), F.col("edit_no").cast("string")))
