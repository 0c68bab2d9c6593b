"""Corpus mining: learnable sentences and readability of texts.

A sentence is one line of a document, keyed by (doc_id, line_no). Token work
is done per row with array functions first (split, normalise, de-duplicate,
length bounds) so only short candidate sentences are exploded and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.functions.text import word_normalise
from recall.operators.idsets import fetched
from recall.operators.ordering import first_within
from recall.operators.vocab import arrival_order, articles_of
from recall.session import shared_dir
from recall.sources.tables import materialize

# --- fixed values: greetings a generated sentence must not start with ---
GREETINGS = ["hola", "hello", "bonjour", "hallo"]
MIN_WORDS, MAX_WORDS = 3, 12  # "keep the sentence short": distinct words per sentence


def story_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, word_no, token): lines on '\\n', then words after each space.

    The space stays on the token, as the reader's ``split_inclusive(' ')`` does;
    empty lines give no token.
    """
    lines = docs.select(key, *[c for c in docs.columns if c not in (key, text)],
                        F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    toks = lines.select(*[c for c in lines.columns if c != "line"],
                        F.posexplode(F.split("line", "(?<= )", -1)).alias("word_no", "token"))
    return toks.where(F.col("token") != F.lit(""))


def first_tokens(tokens: DataFrame) -> DataFrame:
    """(lang, token, first): the distinct tokens of each language and the earliest place of each, as one number.

    Rules about words then run on these rows, not on every token of the corpus.
    """
    place = arrival_order(["doc_id", "line_no", "word_no"])
    return tokens.groupBy("lang", "token").agg(F.min(place).alias("first"))


def _line_words(line) -> F.Column:
    """Distinct normalised words of a line in first-seen order."""
    normed = F.transform(F.split(line, " ", -1), word_normalise)
    return F.array_distinct(F.filter(normed, lambda w: w != F.lit("")))


def sentence_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, line_no, line, words) of every line."""
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("*", _line_words(F.col("line")).alias("words"))


def new_word_sentences(docs: DataFrame, words: DataFrame, min_words: int = MIN_WORDS,
                       max_words: int = MAX_WORDS, by_id_set: bool = False) -> DataFrame:
    """Sentences with exactly one distinct word missing from the vocabulary.

    The new word is not an article; the sentence is short and does not open
    with a greeting. Only keys and words go through the word join and the
    per-sentence aggregate (fixed-width buffers: a count and the unknown word's
    position); the surviving keys are joined back to their documents for the text.
    ``doc_id`` identifies a document. ``by_id_set`` leaves documents without such a sentence out before that
    join (``idsets.fetched``): for corpora whose found keys are too many to broadcast, as it writes these first.
    """
    s = sentence_lines(docs).select("doc_id", "lang", "line_no", "words")
    s = s.where(F.size("words").between(min_words, max_words)
                & ~F.coalesce(F.get("words", 0).isin(*GREETINGS), F.lit(False)))
    exploded = s.select("doc_id", "lang", "line_no", F.posexplode("words").alias("_pos", "word"))
    known = words.select("lang", "word", F.lit(True).alias("_known"))
    j = exploded.join(known, ["lang", "word"], "left")
    unknown = F.col("_known").isNull()
    per = j.groupBy("doc_id", "line_no").agg(
        F.count(F.when(unknown, F.lit(1))).alias("_n_unknown"),
        F.max(F.when(unknown, F.col("_pos"))).alias("_pos"),
    ).where(F.col("_n_unknown") == 1)
    wanted = per.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "_pos")).alias("_wanted"))
    joined = fetched(docs.select("doc_id", "lang", "text"), wanted, "doc_id") if by_id_set else docs.join(wanted, "doc_id")
    found = joined.select("doc_id", "lang", F.split("text", "\n", -1).alias("_lines"), F.explode("_wanted").alias("_w"))
    found = found.select("doc_id", "lang", F.col("_w.line_no").alias("line_no"),
                         F.get("_lines", F.col("_w.line_no")).alias("sentence"), F.col("_w._pos").alias("_pos"))
    found = found.withColumn("_words", _line_words(F.col("sentence"))).select(
        "doc_id", "lang", "line_no", "sentence", F.size("_words").cast("long").alias("n_words"),
        F.get("_words", F.col("_pos")).alias("new_word"))
    return found.where(~F.array_contains(articles_of(F.col("lang")), F.col("new_word")))


def next_words(sentences: DataFrame, k: int = 50) -> DataFrame:
    """Top-k unknown words by how many sentences each one unlocks."""
    counts = sentences.groupBy("lang", "new_word").agg(F.count(F.lit(1)).alias("n_sentences"))
    return counts.orderBy(F.desc("n_sentences"), "lang", "new_word").limit(k)


EXPANSION_BUCKETS = 64


def expansion_plan(docs: DataFrame, words: DataFrame, steps: int, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """The order in which to learn new words: (lang, step, word, n_unlocked, n_readable).

    Every step learns, in each language, the word that makes the most further sentences readable (all their words
    known); of equal ones the first by spelling. Words learnt before count as known, so a sentence with three unknown words
    can be unlocked by the third. Articles are never learnt. A language ends early when no single word unlocks a
    sentence. Sentences are those that ``new_word_sentences`` may choose; ``n_readable`` is the running sum of ``n_unlocked``.

    An inverted index, partitioned by a hash of (lang, word), gives each unknown word its sentences with their
    unknown words. The words' counts are made once; a step reads the index of the chosen words alone, and
    adds one to the last unknown word of each sentence that now lacks one. As counts of words not yet learnt only rise, a
    step's best word is among the first ``steps`` of the first counts or has been raised since. The
    driver holds the words learnt: one per language and step.
    """
    spark = docs.sparkSession
    s = sentence_lines(docs).select("doc_id", "lang", "line_no", "words").where(
        F.col("lang").isNotNull() & F.size("words").between(min_words, max_words)
        & ~F.coalesce(F.get("words", 0).isin(*GREETINGS), F.lit(False)))
    each = s.select("doc_id", "lang", "line_no", F.explode("words").alias("word"))
    unknown = each.join(words.select("lang", "word").distinct(), ["lang", "word"], "left_anti")
    # A sentence has at most max_words unknown words; those with more than steps cannot be unlocked.
    sentences = unknown.groupBy("lang", "doc_id", "line_no").agg(F.sort_array(F.collect_list("word")).alias("unknown")).where(
        F.size("unknown") <= steps)
    bucket = lambda word: F.pmod(F.xxhash64("lang", word), F.lit(EXPANSION_BUCKETS)).cast("int")
    path = shared_dir(spark, "work", "unknown_word_index")
    sentences.select("lang", F.explode("unknown").alias("word"), "unknown").withColumn("bucket", bucket("word")).hint(
        "rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    index = spark.read.schema("lang string, word string, unknown array<string>, bucket int").parquet(path)
    learnable = ~F.array_contains(articles_of(F.col("lang")), F.col("word"))
    order = [F.desc("n"), F.asc("word")]
    first = materialize(index.where(F.size("unknown") == 1).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(learnable), "first_counts")
    top = materialize(first.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= steps).drop("_r"), "first_best")
    learnt, plan, raised = {}, [], None
    for step in range(1, steps + 1):
        known = spark.createDataFrame([(lang, w) for lang, ws in learnt.items() for w in ws], "lang string, word string")
        counts = top
        if raised is not None:
            again = raised.select("lang", "word").distinct()
            counts = top.unionByName(first.join(again, ["lang", "word"], "left_semi")).distinct().unionByName(raised)
        counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).join(F.broadcast(known), ["lang", "word"], "left_anti")
        best = counts.groupBy("lang").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("b")).collect()
        if not best:
            break
        for r in best:
            plan.append((r["lang"], step, r["b"]["word"], -r["b"]["n"]))
            learnt.setdefault(r["lang"], []).append(r["b"]["word"])
        # The sentences of the words just learnt, and what they still lack.
        chosen = spark.createDataFrame([(r["lang"], r["b"]["word"]) for r in best], "lang string, word string")
        buckets = [x[0] for x in chosen.select(bucket("word")).distinct().collect()]
        now = F.broadcast(spark.createDataFrame(list(learnt.items()), "lang string, _learnt array<string>"))
        touched = index.where(F.col("bucket").isin(buckets)).join(F.broadcast(chosen), ["lang", "word"], "left_semi").join(now, "lang")
        lacking = touched.select("lang", F.array_except("unknown", "_learnt").alias("_rest")).where(F.size("_rest") == 1)
        more = lacking.select("lang", F.get("_rest", 0).alias("word")).where(learnable).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        raised = materialize(more if raised is None else raised.unionByName(more).groupBy("lang", "word").agg(F.sum("n").alias("n")), "raised_counts")
    out = spark.createDataFrame(plan, "lang string, step int, word string, n_unlocked long")
    return out.withColumn("n_readable", F.sum("n_unlocked").over(Window.partitionBy("lang").orderBy("step")))


def doc_word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, word, n): occurrences of each normalised word in each document.

    Splitting on spaces and newlines gives the reader's tokens up to the
    trailing space, which normalisation strips anyway.
    """
    toks = docs.select("doc_id", "lang", F.explode(F.split("text", "[ \n]", -1)).alias("t"))
    normed = toks.select("doc_id", "lang", word_normalise("t").alias("word")).where(F.col("word") != F.lit(""))
    return normed.groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_coverage(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Per document: tokens and distinct words, and how many are already known."""
    return coverage_from_counts(doc_word_counts(docs), words)


def coverage_from_counts(per_word: DataFrame, words: DataFrame) -> DataFrame:
    per_word = per_word.withColumnRenamed("n", "_n")
    # One row a word: hashed, so that the far longer counts run past it and no task sorts its share of them.
    known = words.select("lang", "word", F.lit(True).alias("_known")).hint("shuffle_hash")
    j = per_word.join(known, ["lang", "word"], "left")
    is_known = F.col("_known").isNotNull()
    per_doc = j.groupBy("doc_id", "lang").agg(
        F.sum("_n").alias("n_tokens"),
        F.sum(F.when(is_known, F.col("_n")).otherwise(F.lit(0))).alias("n_known"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count(F.when(is_known, F.lit(1))).alias("n_distinct_known"),
    )
    return per_doc.withColumn("known_share", F.col("n_known") / F.col("n_tokens"))


def reading_list(coverage: DataFrame, k: int, min_tokens: int = 1) -> DataFrame:
    """The ``k`` most readable texts of each language, from the rows of ``vocabulary_coverage``.

    (lang, rank, doc_id, n_tokens, n_known, n_unknown, known_share): by share of known tokens, then by fewer distinct
    unknown words to look up, then the longer text, then by id. Texts under ``min_tokens`` tokens are left out:
    a text of one known word is wholly readable and no reading. A null language is a language of its own.
    """
    rows = coverage.where(F.col("n_tokens") >= min_tokens).select(
        "lang", "doc_id", "n_tokens", "n_known", (F.col("n_distinct") - F.col("n_distinct_known")).alias("n_unknown"), "known_share")
    order = [F.desc("known_share"), F.asc("n_unknown"), F.desc("n_tokens"), F.asc("doc_id")]
    return first_within(rows, ["lang"], order, k)
