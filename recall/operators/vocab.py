"""Vocabulary maintenance and look-ups as set-based jobs.

The vocabulary is one table ``(lang, word, translation, created_at)`` keyed by
``(lang, word)``. A null translation is a miss; an empty one is a hit.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.functions.text import LANGUAGE_CODES, language_code, word_normalise
from recall.operators.maintenance import last_edits

# --- fixed values: articles never taken as vocabulary or as a new word ---
# Spanish and English come from the application's prompts; French, German and
# Portuguese are the same rule for the other supported languages.
ARTICLES = {
    "es": ["el", "la", "los", "las", "un", "una", "unos", "unas"],
    "en": ["a", "an", "the"],
    "fr": ["le", "la", "les", "l", "un", "une", "des"],
    "de": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines"],
    "pt-PT": ["o", "a", "os", "as", "um", "uma", "uns", "umas"],
}


def articles_of(lang_col) -> F.Column:
    """``array<string>`` of the articles of a language (empty when unknown)."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(w) for w in v])) for k, v in ARTICLES.items()))
    return F.coalesce(F.element_at(m, lang_col), F.array().cast("array<string>"))


# --- fixed values: languages that write common nouns with a capital, where it tells nothing about names ---
CAPITALISED_NOUNS = ["de"]
SENTENCE_END = r"[.!?:…][^\p{L}]*$"
CAPITAL = r"^[^\p{L}]*\p{Lu}"

ARRIVAL_DIGITS = (19, 10, 9)  # of up to three whole numbers, most significant first


def arrival_order(arrival: list[str]) -> F.Column:
    """Up to three non-negative whole numbers as one decimal with the same order (a fixed-width aggregate buffer)."""
    if len(arrival) > len(ARRIVAL_DIGITS):
        raise ValueError("at most three arrival columns")
    order = F.lit(0).cast("decimal(38,0)")
    for column, digits in zip(arrival, ARRIVAL_DIGITS):
        order = (order * F.lit(str(10 ** digits)).cast(f"decimal({digits + 1},0)") + F.col(column)).cast("decimal(38,0)")
    return order


def words_add_new(words: DataFrame, new_rows: DataFrame, arrival: list[str] | None, created_at) -> DataFrame:
    """Insert-if-absent: a stored row wins, else one new row of the key.

    With ``arrival`` (up to three non-negative whole numbers that identify a new row) it is
    the earliest: rows with one translation become one by a hash aggregate, whose shuffle serves both the keys'
    smallest arrivals and the translations that join them. Without it, it is the row with the smallest translation.
    """
    stored = words.select("lang", "word", "translation", "created_at")
    if arrival is None:
        fresh = new_rows.groupBy("lang", "word").agg(F.min("translation").alias("translation"))
    else:
        rows = new_rows.groupBy("lang", "word", "translation").agg(F.min(arrival_order(arrival)).alias("_arrival"))
        first = rows.groupBy("lang", "word").agg(F.min("_arrival").alias("_arrival"))
        fresh = rows.join(first, ["lang", "word", "_arrival"]).select("lang", "word", "translation")
    fresh = fresh.join(words.select("lang", "word"), ["lang", "word"], "left_anti")
    return stored.unionByName(fresh.select("lang", "word", "translation", created_at.alias("created_at")))


def words_update(words: DataFrame, edits: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Set the translation of existing keys; edits of unknown words change nothing.

    Of several edits of a word the last by ``order`` counts.
    """
    e = last_edits(edits, ["lang", "word"], order).select(
        "lang", "word", F.col("translation").alias("_new"), F.lit(True).alias("_hit"))
    j = words.join(e, ["lang", "word"], "left")
    return j.select("lang", "word", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("translation")).alias(
        "translation"), "created_at")


def words_delete(words: DataFrame, keys: DataFrame) -> DataFrame:
    return words.join(keys.select("lang", "word"), ["lang", "word"], "left_anti")


def word_lookup(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Attach the stored translation to (lang, word) rows; ``hit`` = not null."""
    w = words.select("lang", "word", "translation")
    return tokens.join(w, ["lang", "word"], "left").withColumn("hit", F.col("translation").isNotNull())


def word_lookup_fallback(tokens: DataFrame, words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Stored translation, else the dictionary's; ``resolved_by`` names the source.

    Rows with a null ``translation`` are the unresolved words to enrich.
    """
    stored = words.select("lang", "word", F.col("translation").alias("_stored"))
    second = dictionary.select("lang", "word", F.col("translation").alias("_dict"))
    j = tokens.join(stored, ["lang", "word"], "left").join(second, ["lang", "word"], "left")
    by = (F.when(F.col("_stored").isNotNull(), F.lit("vocabulary"))
          .when(F.col("_dict").isNotNull(), F.lit("dictionary")))
    return j.select(*tokens.columns, F.coalesce("_stored", "_dict").alias("translation"),
                    by.alias("resolved_by"))


def cards_by_language(cards: DataFrame, tags: DataFrame) -> DataFrame:
    """(lang, answer) of the cards tagged with a language name."""
    lang_tags = tags.where(F.col("tag").isin(*LANGUAGE_CODES)).select(
        F.col("card_id").alias("id"), language_code(F.col("tag")).alias("lang"))
    return cards.select("id", "answer").join(lang_tags, "id", "inner").select("lang", "answer")


def word_case_counts(texts: DataFrame, text: str = "answer") -> DataFrame:
    """(lang, word, n_capital, n_lower): how often a word stands inside a sentence with and without a capital.

    The first word of a line, and one after a word that ends a sentence, are left out: any word has a capital
    there. Counts of parts of the texts add up (``merge_case_counts``).
    """
    lines = texts.select("lang", F.explode(F.split(text, "\n", -1)).alias("_line"))
    tokens = lines.select("lang", F.filter(F.split("_line", " ", -1), lambda t: t.rlike(r"\p{L}")).alias("_t"))
    inside = F.filter(F.transform("_t", lambda t, i: F.when(
        (i > 0) & ~F.get("_t", i - 1).rlike(SENTENCE_END), t)), lambda t: t.isNotNull())
    each = tokens.select("lang", F.explode(inside).alias("_token")).select(
        "lang", word_normalise("_token").alias("word"), F.col("_token").rlike(CAPITAL).alias("_capital"))
    return each.groupBy("lang", "word").agg(
        F.count(F.when(F.col("_capital"), 1)).alias("n_capital"), F.count(F.when(~F.col("_capital"), 1)).alias("n_lower"))


def merge_case_counts(*parts: DataFrame) -> DataFrame:
    """The counts of all texts from those of their parts, e.g. a stored table and a day's new cards."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("lang", "word").agg(F.sum("n_capital").alias("n_capital"), F.sum("n_lower").alias("n_lower"))


def likely_names(counts: DataFrame, least: int = 3, percent: int = 80) -> DataFrame:
    """(lang, word) of names and places: ``least`` times or more with a capital inside a sentence, and ``percent`` of the time.

    No word of a language that writes all nouns with a capital is taken for a name.
    """
    n, all_ = F.col("n_capital"), F.col("n_capital") + F.col("n_lower")
    return counts.where(~F.col("lang").isin(*CAPITALISED_NOUNS) & (n >= least) & (100 * n >= percent * all_)).select("lang", "word")


def words_from_cards(cards: DataFrame, tags: DataFrame, words: DataFrame, created_at,
                     exclude: DataFrame | None = None) -> DataFrame:
    """Add the words of each language's cards to its vocabulary (empty translation).

    Cards tagged with a language name feed that language. Words are the
    normalised tokens of the answers minus articles and minus ``exclude``
    (e.g. ``likely_names`` of the cards); existing words keep their row.
    """
    # Most tokens repeat: only distinct ones are normalised.
    toks = cards_by_language(cards, tags).select("lang", F.explode(F.split("answer", "[ \n]", -1)).alias("t")).distinct()
    extracted = toks.select("lang", word_normalise("t").alias("word")).where(F.col("word") != F.lit(""))
    extracted = extracted.where(~F.array_contains(articles_of(F.col("lang")), F.col("word"))).distinct()
    if exclude is not None:
        extracted = extracted.join(exclude.select("lang", "word"), ["lang", "word"], "left_anti")
    return words_add_new(words, extracted.withColumn("translation", F.lit("")), None, created_at)
