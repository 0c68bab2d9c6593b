"""Every operator of the card store as a query over the shared test tables.

``QUERIES[name] = (spark_fn, oracle_sql)``: ``spark_fn(spark, sf_dir)`` returns
a DataFrame; ``oracle_sql`` is the DuckDB form over the raw tables, or None
where SQL cannot express the operator. Arrays are returned joined into strings
and integers as longs so both sides hash alike.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.functions import text as tx
from recall.operators import cards as co
from recall.operators import idsets as ids
from recall.operators.maintenance import cards_add, cards_update
from recall.operators import mining as mi
from recall.operators import schedule as sc
from recall.operators import stats as st
from recall.operators import vocab as vo
from recall.plans import prompts as pr
from recall.plans.oracle import (
    ANSWERS_FROM, ANSWERS_SQL, AS_OF, FIRST_INTERVAL_SECS, articles_sql, distinct_ordered, due_sql, interval_sql, lang_code_sql,
    lang_name_sql, norm, overflow_sql, replay_sql, state_with_cards_sql, utrim, with_ctes,
)
from recall.session import shared_dir
from recall.sources import fixtures as fx
from recall.sources import tables as tb
from recall.sources.bucket_store import CardStore, WordStore
from recall.schema import DRAFT_SOURCE

QUERIES: dict[str, tuple] = {}

CARD_BY_ID = 42
TAG = "spanish"
WORDS_LANG = "es"
NEXT_WORDS_K = 50
READING_K, READING_MIN_TOKENS = 100, 30
EXPANSION_STEPS = 6
STORE_BUCKETS = 16


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


def as_of():
    return fx.ts(fx.DEFAULT_AS_OF)


def joined_tags(df: DataFrame, col: str = "tags", sep: str = ",") -> DataFrame:
    return df.withColumn(col, F.array_join(col, sep))


def _lang_name(c):
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(fx.DOC_LANGUAGE_NAMES.items())])
    return F.element_at(m, c)


CARD_COLS = "id, question, answer, examples, source, img, last_reviewed, review_after_secs, question_img"

# --- 2.1 scans, sources, sinks ----------------------------------------------------


@query("scan_cards", with_ctes(["cards"], f"SELECT {CARD_COLS} FROM cards"))
def q_scan_cards(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "cards")
    fx.cards(spark, sf).write.mode("overwrite").parquet(path)
    return tb.scan_cards(spark, path)


@query("scan_review_history", with_ctes(["reviews"], "SELECT card_id, review_date, remembered FROM reviews"))
def q_scan_review_history(spark, sf):
    path = shared_dir(spark, "reviews")
    fx.reviews(spark, sf).write.mode("overwrite").parquet(path)
    return tb.scan_review_history(spark, path)


def _written_words(spark, sf) -> str:
    path = shared_dir(spark, "vocabulary")
    tb.write_words(fx.words(spark, sf), path)
    return path


@query("scan_words", with_ctes(["words"], "SELECT lang, word, translation, created_at FROM words"))
def q_scan_words(spark, sf):
    return tb.scan_words(spark, _written_words(spark, sf))


@query("words_of_language", with_ctes(["words"], f"""
    SELECT lang, word, translation, created_at FROM words WHERE lang = '{WORDS_LANG}'"""))
def q_words_of_language(spark, sf):
    return tb.words_of_language(spark, _written_words(spark, sf), WORDS_LANG)


# --- 2.2 projections and filters -----------------------------------------------------


@query("cards_due", with_ctes(["cards_all"], f"""
    SELECT * FROM cards_all WHERE {due_sql('last_reviewed', 'review_after_secs')} < {AS_OF}"""))
def q_cards_due(spark, sf):
    return joined_tags(co.cards_due(fx.cards(spark, sf), fx.flashcard_tags(spark, sf), as_of()))


@query("cards_due_stored", QUERIES["cards_due"][1])
def q_cards_due_stored(spark, sf):
    """The cards as a store clustered on the due time, whose scan takes the filter."""
    path = shared_dir(spark, "cards_by_due")
    tb.write_cards_by_due(fx.cards(spark, sf), path)
    return joined_tags(co.cards_due(tb.scan_cards_by_due(spark, path), fx.flashcard_tags(spark, sf), as_of()))


@query("cards_by_tag", with_ctes(["cards", "flashcard_tags"], f"""
    SELECT c.*, t.tag AS tags FROM cards c JOIN flashcard_tags t ON c.id = t.card_id WHERE t.tag = '{TAG}'"""))
def q_cards_by_tag(spark, sf):
    return joined_tags(co.cards_by_tag(fx.cards(spark, sf), fx.flashcard_tags(spark, sf), TAG))


@query("card_by_id", with_ctes(["cards_all"], f"SELECT * FROM cards_all WHERE id = {CARD_BY_ID}"))
def q_card_by_id(spark, sf):
    return joined_tags(co.card_by_id(fx.cards(spark, sf), fx.flashcard_tags(spark, sf), CARD_BY_ID))


@query("card_listing", with_ctes(["cards", "flashcard_tags"], """
    SELECT c.id, c.question, c.answer, string_agg(t.tag, ', ' ORDER BY t.tag) AS tags,
           strftime(c.last_reviewed, '%Y-%m-%d %H:%M') AS last_reviewed
    FROM cards c JOIN flashcard_tags t ON c.id = t.card_id
    GROUP BY c.id, c.question, c.answer, c.last_reviewed"""))
def q_card_listing(spark, sf):
    return co.card_listing(co.cards_all(fx.cards(spark, sf), fx.flashcard_tags(spark, sf)))


@query("card_media_links", with_ctes(["cards"], """
    SELECT id, '/media/' || img AS img_link, '/media/' || question_img AS question_img_link FROM cards"""))
def q_card_media_links(spark, sf):
    return co.card_media_links(fx.cards(spark, sf))


FORMS_SQL = f"""
    SELECT item_id, split_part(text, chr(10), 1) AS question, text AS answer, '' AS examples,
           'benchmark' AS source, ' benchmark, ' || split_part(text, ' ', 1) || ' ,benchmark' AS tags_text
    FROM benchmark"""


def _parse_sql(x: str) -> str:
    parts = f"list_transform(string_split({x}, ','), lambda p: {utrim('p')})"
    return distinct_ordered(parts)


@query("card_drafts", with_ctes([], f"""
    SELECT item_id, CAST(0 AS BIGINT) AS id, question, answer, examples, source, CAST(NULL AS VARCHAR) AS img,
           {AS_OF} AS last_reviewed, CAST({FIRST_INTERVAL_SECS} AS BIGINT) AS review_after_secs,
           CAST(NULL AS VARCHAR) AS question_img, array_to_string({_parse_sql('tags_text')}, '|') AS tags
    FROM ({FORMS_SQL}) f"""))
def q_card_drafts(spark, sf):
    return joined_tags(co.card_drafts(fx.card_forms(spark, sf), as_of()), sep="|")


def _mined(spark, sf) -> DataFrame:
    return mi.new_word_sentences(fx.documents(spark, sf), fx.words(spark, sf))


@query("drafts_from_sentences", with_ctes(["new_word_sentences"], f"""
    SELECT doc_id, line_no, CAST(0 AS BIGINT) AS id, '' AS question, sentence AS answer, '' AS examples,
           '{DRAFT_SOURCE}' AS source, CAST(NULL AS VARCHAR) AS img, {AS_OF} AS last_reviewed,
           CAST({FIRST_INTERVAL_SECS} AS BIGINT) AS review_after_secs, CAST(NULL AS VARCHAR) AS question_img,
           {lang_name_sql('lang')} AS tags
    FROM new_word_sentences"""))
def q_drafts_from_sentences(spark, sf):
    s = _mined(spark, sf).select("doc_id", "line_no", F.col("sentence").alias("text"),
                                 _lang_name(F.col("lang")).alias("language"))
    d = co.drafts_from_sentences(s, as_of())
    return joined_tags(d).select("doc_id", F.col("line_no").cast("long"), *[c for c in d.columns
                                                                             if c not in ("doc_id", "line_no")])


@query("drafts_from_story", with_ctes(["doc_lines"], f"""
    SELECT doc_id, line_no, CAST(0 AS BIGINT) AS id, reverse(line) AS question, line AS answer, '' AS examples,
           '{DRAFT_SOURCE}' AS source, CAST(NULL AS VARCHAR) AS img, {AS_OF} AS last_reviewed,
           CAST({FIRST_INTERVAL_SECS} AS BIGINT) AS review_after_secs, CAST(NULL AS VARCHAR) AS question_img,
           {lang_name_sql('lang')} AS tags
    FROM doc_lines WHERE line <> ''"""))
def q_drafts_from_story(spark, sf):
    """Every line of every document as a story sentence; its reversal stands for the translation."""
    lines = fx.documents(spark, sf, streamed=True).select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    s = lines.where(F.col("text") != "").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "text", F.reverse("text").alias("translation"),
        _lang_name(F.col("lang")).alias("language"))
    return joined_tags(co.drafts_from_sentences(s, as_of(), from_story=True))


# --- 2.3 joins ----------------------------------------------------------------------


@query("cards_all", with_ctes(["cards_all"], "SELECT * FROM cards_all"))
def q_cards_all(spark, sf):
    return joined_tags(co.cards_all(fx.cards(spark, sf), fx.flashcard_tags(spark, sf)))


def _word_tokens(stats: DataFrame) -> DataFrame:
    return stats.select("lang", "word", "n_occurrences")


TOKENS_SQL = "SELECT lang, word, count(*) AS n_occurrences FROM doc_words GROUP BY lang, word"


@query("word_lookup", with_ctes(["doc_words", "words"], f"""
    SELECT t.lang, t.word, t.n_occurrences, w.translation, w.translation IS NOT NULL AS hit
    FROM ({TOKENS_SQL}) t LEFT JOIN words w ON t.lang = w.lang AND t.word = w.word"""))
def q_word_lookup(spark, sf):
    stats = fx.word_stats(spark, sf)
    return vo.word_lookup(_word_tokens(stats), fx.words(spark, sf, stats))


@query("word_lookup_fallback", with_ctes(["doc_words", "words", "dictionary"], f"""
    SELECT t.lang, t.word, t.n_occurrences, coalesce(w.translation, d.translation) AS translation,
           CASE WHEN w.translation IS NOT NULL THEN 'vocabulary'
                WHEN d.translation IS NOT NULL THEN 'dictionary' END AS resolved_by
    FROM ({TOKENS_SQL}) t
    LEFT JOIN words w ON t.lang = w.lang AND t.word = w.word
    LEFT JOIN dictionary d ON t.lang = d.lang AND t.word = d.word"""))
def q_word_lookup_fallback(spark, sf):
    stats = fx.word_stats(spark, sf)
    return vo.word_lookup_fallback(_word_tokens(stats), fx.words(spark, sf, stats), fx.dictionary(spark, sf, stats))


@query("reviews_quarantine", with_ctes(["reviews_big", "cards"], """
    SELECT r.card_id, r.review_date, r.remembered,
           CASE WHEN c.id IS NULL THEN 'quarantined' ELSE 'accepted' END AS status
    FROM reviews_big r LEFT JOIN cards c ON r.card_id = c.id"""))
def q_reviews_quarantine(spark, sf):
    return co.reviews_quarantine(fx.reviews_big(spark, sf), fx.cards(spark, sf))


@query("reviews_quarantine_by_set", QUERIES["reviews_quarantine"][1])
def q_reviews_quarantine_by_set(spark, sf):
    return ids.mark_known_by_set(fx.reviews_big(spark, sf), fx.cards(spark, sf).select(F.col("id").alias("card_id")), "card_id")


@query("tags_quarantine", with_ctes(["cards"], """
    SELECT p.p_partkey AS card_id, p.p_brand AS tag,
           CASE WHEN c.id IS NULL THEN 'quarantined' ELSE 'accepted' END AS status
    FROM part p LEFT JOIN cards c ON p.p_partkey = c.id"""))
def q_tags_quarantine(spark, sf):
    return co.tags_quarantine(fx.imported_tags(spark, sf), fx.cards(spark, sf))


@query("tags_quarantine_by_set", QUERIES["tags_quarantine"][1])
def q_tags_quarantine_by_set(spark, sf):
    return ids.mark_known_by_set(fx.imported_tags(spark, sf), fx.cards(spark, sf).select(F.col("id").alias("card_id")), "card_id")


# --- 2.4 aggregations -------------------------------------------------------------------


@query("tags_by_card", with_ctes(["tag_groups"], "SELECT card_id, tags, n_tags FROM tag_groups"))
def q_tags_by_card(spark, sf):
    t = co.tags_by_card(fx.flashcard_tags(spark, sf))
    return t.select("card_id", F.array_join("tags", ",").alias("tags"), F.size("tags").cast("long").alias("n_tags"))


@query("avg_reviews_per_month", with_ctes(["reviews_big"], """
    SELECT avg(reviews) AS avg_reviews_per_month FROM (
      SELECT card_id, strftime(review_date, '%Y-%m') AS year_month, count(*) AS reviews
      FROM reviews_big GROUP BY card_id, year_month) m"""))
def q_avg_reviews_per_month(spark, sf):
    return st.avg_reviews_per_month(fx.reviews_big(spark, sf))


@query("card_count", with_ctes(["cards", "flashcard_tags"], """
    SELECT count(*) AS n_cards FROM cards WHERE id IN (SELECT card_id FROM flashcard_tags)"""))
def q_card_count(spark, sf):
    return co.card_count(fx.cards(spark, sf), fx.flashcard_tags(spark, sf))


@query("word_count", with_ctes(["words"], "SELECT lang, count(*) AS n_words FROM words GROUP BY lang"))
def q_word_count(spark, sf):
    return st.word_count(fx.words(spark, sf))


CORPUS_SQL = f"""
    SELECT t.tag, CAST(floor(c.id / {st.CORPUS_CHUNK_CARDS}) AS BIGINT) AS chunk, count(*) AS n_cards,
           string_agg(c.answer, chr(10) ORDER BY c.id) AS corpus
    FROM cards c JOIN flashcard_tags t ON c.id = t.card_id
    WHERE t.tag IN ({", ".join(f"'{k}'" for k in tx.LANGUAGE_CODES)})
    GROUP BY t.tag, chunk"""


@query("sentences_corpus", with_ctes(["cards", "flashcard_tags"], CORPUS_SQL))
def q_sentences_corpus(spark, sf):
    return st.sentences_corpus(fx.cards(spark, sf), fx.flashcard_tags(spark, sf)).withColumn(
        "n_cards", F.col("n_cards").cast("long"))


@query("schedule_state", with_ctes(["dedup_big"], f"""
    SELECT card_id, last_review AS last_reviewed,
           {interval_sql(str(FIRST_INTERVAL_SECS), 'last_fail IS NOT NULL', 'streak')} AS review_after_secs,
           n_reviews, streak, {overflow_sql(str(FIRST_INTERVAL_SECS), 'last_fail IS NOT NULL', 'streak')} AS overflow
    FROM ({replay_sql('dedup_big')}) s"""))
def q_schedule_state(spark, sf):
    return sc.schedule_state(fx.reviews_big(spark, sf))


COVERAGE_SQL = """
    SELECT doc_id, lang, CAST(sum(n) AS BIGINT) AS n_tokens,
           CAST(sum(CASE WHEN known THEN n ELSE 0 END) AS BIGINT) AS n_known,
           count(*) AS n_distinct, count(*) FILTER (WHERE known) AS n_distinct_known,
           sum(CASE WHEN known THEN n ELSE 0 END) / sum(n) AS known_share
    FROM (SELECT t.doc_id, t.lang, t.word, count(*) AS n, any_value(w.word IS NOT NULL) AS known
          FROM doc_words t LEFT JOIN words w ON t.lang = w.lang AND t.word = w.word
          GROUP BY t.doc_id, t.lang, t.word) x
    GROUP BY doc_id, lang"""


@query("vocabulary_coverage", with_ctes(["doc_words", "words"], COVERAGE_SQL))
def q_vocabulary_coverage(spark, sf):
    counts = tb.materialize(fx.doc_word_counts(spark, sf), "doc_word_counts")
    return mi.coverage_from_counts(counts, fx.words(spark, sf, fx.word_stats(spark, sf, counts)))


@query("reading_list", with_ctes(["doc_words", "words"], f"""
    , coverage AS ({COVERAGE_SQL})
    , ranked AS (SELECT *, n_distinct - n_distinct_known AS n_unknown FROM coverage WHERE n_tokens >= {READING_MIN_TOKENS})
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY known_share DESC, n_unknown, n_tokens DESC, doc_id) AS rank,
           doc_id, n_tokens, n_known, n_unknown, known_share
    FROM ranked QUALIFY rank <= {READING_K}"""))
def q_reading_list(spark, sf):
    return mi.reading_list(q_vocabulary_coverage(spark, sf), READING_K, READING_MIN_TOKENS)


# --- 2.5 table maintenance ---------------------------------------------------------------


@query("cards_add", with_ctes(["cards"], f"""
    SELECT (SELECT coalesce(max(id), 0) FROM cards) + row_number() OVER (ORDER BY item_id) AS id,
           item_id, question, answer, examples, source, CAST(NULL AS VARCHAR) AS img, {AS_OF} AS last_reviewed,
           CAST({FIRST_INTERVAL_SECS} AS BIGINT) AS review_after_secs, CAST(NULL AS VARCHAR) AS question_img,
           array_to_string({_parse_sql('tags_text')}, '|') AS tags
    FROM ({FORMS_SQL}) f"""))
def q_cards_add(spark, sf):
    drafts = co.card_drafts(fx.card_forms(spark, sf), as_of())
    new_cards, new_tags = cards_add(fx.cards(spark, sf), drafts, ["item_id"])
    tags = new_tags.groupBy("card_id").agg(F.collect_list(F.struct("_pos", "tag")).alias("_t"))
    tags = tags.select(F.col("card_id").alias("id"),
                       F.array_join(F.transform(F.array_sort("_t"), lambda x: x["tag"]), "|").alias("tags"))
    return new_cards.join(tags, "id", "left").select(
        "id", "item_id", "question", "answer", "examples", "source", "img", "last_reviewed", "review_after_secs",
        "question_img", "tags")


def _edited_sql(columns: list[str]) -> str:
    return ",\n           ".join(f"CASE WHEN e.id IS NOT NULL THEN e.{c} ELSE c.{c} END AS {c}" for c in columns)


@query("cards_update", with_ctes(["cards", "flashcard_tags"], f"""
    , edits AS (SELECT id, CASE WHEN id % 40 = 0 THEN 'edited 2: ' ELSE 'edited 1: ' END || question AS question, answer,
                       CAST(NULL AS VARCHAR) AS examples, source, img, question_img,
                       CASE WHEN id % 40 = 0 THEN 'edited2' ELSE 'edited1' END AS mark FROM cards WHERE id % 20 = 0)
    , new_cards AS (
    SELECT c.id, {_edited_sql(["question", "answer", "examples", "source", "img", "question_img"])},
           c.last_reviewed, c.review_after_secs
    FROM cards c LEFT JOIN edits e ON e.id = c.id)
    , new_tags AS (SELECT card_id, tag FROM flashcard_tags WHERE card_id NOT IN (SELECT id FROM edits)
                   UNION SELECT id, mark FROM edits UNION SELECT id, source FROM edits)
    SELECT c.*, g.tags FROM new_cards c
    JOIN (SELECT card_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM new_tags GROUP BY card_id) g
      ON c.id = g.card_id"""))
def q_cards_update(spark, sf):
    new_cards, new_tags = cards_update(fx.cards(spark, sf), fx.flashcard_tags(spark, sf), fx.card_edits(spark, sf), ["edit_no"])
    return joined_tags(co.cards_all(new_cards, new_tags))


APPLY_CTES = f"""
    , answers AS ({ANSWERS_SQL})
    , past AS (SELECT * FROM reviews WHERE review_date < TIMESTAMP '{ANSWERS_FROM}')
    , new_rows AS (SELECT card_id, answered_at AS review_date, bool_and(answer = 'y') AS remembered FROM answers
                   WHERE answer IN ('y', 'n') AND card_id IN (SELECT id FROM cards) GROUP BY ALL)
    , appended AS (SELECT * FROM new_rows n WHERE NOT EXISTS (
                     SELECT 1 FROM past p WHERE p.card_id = n.card_id AND p.review_date = n.review_date))"""


@query("reviews_apply", with_ctes(["reviews", "cards"], f"""{APPLY_CTES}
    , th AS (SELECT * FROM (SELECT * FROM past UNION ALL SELECT * FROM appended) u
             WHERE card_id IN (SELECT card_id FROM new_rows))
    , tc AS (SELECT * FROM cards WHERE id IN (SELECT card_id FROM new_rows))
    {state_with_cards_sql('th', 'tc')}"""))
def q_reviews_apply(spark, sf):
    return _applied(spark, sf)[1]


@query("reviews_apply_rows", with_ctes(["reviews", "cards"], f"""{APPLY_CTES}
    SELECT card_id, review_date, remembered, 'appended' AS outcome FROM appended
    UNION ALL
    SELECT card_id, answered_at, answer = 'y', CASE WHEN card_id NOT IN (SELECT id FROM cards) THEN 'unknown_card' ELSE 'no_change' END
    FROM answers WHERE answer NOT IN ('y', 'n') OR card_id NOT IN (SELECT id FROM cards)"""))
def q_reviews_apply_rows(spark, sf):
    rows, _, rejected = _applied(spark, sf)
    return rows.withColumn("outcome", F.lit("appended")).unionByName(rejected.select(
        "card_id", F.col("answered_at").alias("review_date"), (F.col("answer") == "y").alias("remembered"),
        F.col("reason").alias("outcome")))


def _applied(spark, sf):
    return sc.reviews_apply(fx.history_before_answers(spark, sf), fx.answers(spark, sf), fx.cards(spark, sf))


def _new_word_rows_sql() -> str:
    n = norm("piece")
    return f"""
    SELECT lang, word, translation FROM (
      SELECT lang, word, translation,
             row_number() OVER (PARTITION BY lang, word ORDER BY doc_id, line_no, word_no) AS rk
      FROM (SELECT doc_id, lang, line_no, word_no, {n} AS word, {utrim('piece')} AS translation
            FROM doc_tokens) x WHERE word <> '') r WHERE rk = 1"""


@query("words_add_new", with_ctes(["words", "doc_tokens"], f"""
    SELECT lang, word, translation, created_at FROM words
    UNION ALL
    SELECT n.lang, n.word, n.translation, {AS_OF} AS created_at FROM ({_new_word_rows_sql()}) n
    WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.lang = n.lang AND w.word = n.word)"""))
def q_words_add_new(spark, sf):
    toks = mi.first_tokens(mi.story_tokens(fx.documents(spark, sf)))
    rows = toks.select("lang", tx.word_normalise("token").alias("word"), tx.unicode_trim("token").alias("translation"), "first").where(
        F.col("word") != F.lit(""))
    return vo.words_add_new(fx.words(spark, sf), rows, ["first"], as_of())


@query("words_update", with_ctes(["words", "dictionary"], """
    SELECT w.lang, w.word, CASE WHEN d.word IS NULL THEN w.translation
                                WHEN length(d.word) > 6 THEN d.translation || '/2' ELSE d.translation || '/1' END AS translation,
           w.created_at
    FROM words w LEFT JOIN dictionary d ON w.lang = d.lang AND w.word = d.word"""))
def q_words_update(spark, sf):
    stats = fx.word_stats(spark, sf)
    return vo.words_update(fx.words(spark, sf, stats), fx.word_edits(spark, sf, stats), ["edit_no"])


BENCH_WORDS_SQL = f"""
    SELECT DISTINCT 'en' AS lang, w AS word FROM (
      SELECT {norm('t')} AS w
      FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS t FROM benchmark)) WHERE w <> ''"""


def _benchmark_words(spark, sf) -> DataFrame:
    b = tb.read_table(spark, sf, "benchmark", ["text"])
    t = b.select(F.explode(F.split("text", "[ \n]", -1)).alias("t"))
    w = t.select(tx.word_normalise("t").alias("word"))
    return w.where(F.col("word") != F.lit("")).select(F.lit("en").alias("lang"), "word").distinct()


@query("words_delete", with_ctes(["words"], f"""
    SELECT w.lang, w.word, w.translation, w.created_at FROM words w
    WHERE NOT EXISTS (SELECT 1 FROM ({BENCH_WORDS_SQL}) k WHERE k.lang = w.lang AND k.word = w.word)"""))
def q_words_delete(spark, sf):
    return vo.words_delete(fx.words(spark, sf), _benchmark_words(spark, sf))


def _words_from_cards_sql() -> str:
    names = ", ".join(f"'{k}'" for k in tx.LANGUAGE_CODES)
    return f"""
    , extracted AS (
      SELECT DISTINCT lang, word FROM (
        SELECT {lang_code_sql('t.tag')} AS lang, {norm('p')} AS word
        FROM cards c JOIN flashcard_tags t ON c.id = t.card_id,
             LATERAL (SELECT unnest(regexp_split_to_array(c.answer, '[ \\n]')) AS p) x
        WHERE t.tag IN ({names})) y
      WHERE word <> '' AND NOT list_contains({articles_sql('lang')}, word))
    SELECT lang, word, translation, created_at FROM words
    UNION ALL
    SELECT e.lang, e.word, '' AS translation, {AS_OF} AS created_at FROM extracted e
    WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.lang = e.lang AND w.word = e.word)"""


@query("words_from_cards", with_ctes(["cards", "flashcard_tags", "words"], _words_from_cards_sql()))
def q_words_from_cards(spark, sf):
    return vo.words_from_cards(tb.spread(fx.cards(spark, sf), "id", "answer"), fx.flashcard_tags(spark, sf), fx.words(spark, sf), as_of())


def _without_names_sql() -> str:
    names = ", ".join(f"'{k}'" for k in tx.LANGUAGE_CODES)
    return f"""
    , lines AS (
      SELECT lang, list_filter(string_split(line, ' '), lambda x: regexp_matches(x, '\\p{{L}}')) AS l FROM (
        SELECT {lang_code_sql('t.tag')} AS lang, unnest(string_split(c.answer, chr(10))) AS line
        FROM cards c JOIN flashcard_tags t ON c.id = t.card_id WHERE t.tag IN ({names})))
    , inside AS (
      SELECT lang, l[i] AS token FROM (SELECT lang, l, unnest(range(2, len(l) + 1)) AS i FROM lines)
      WHERE NOT regexp_matches(l[i - 1], '[.!?:…][^\\p{{L}}]*$'))
    , names AS (
      SELECT lang, {norm('token')} AS word, count(*) FILTER (regexp_matches(token, '^[^\\p{{L}}]*\\p{{Lu}}')) AS upper, count(*) AS n
      FROM inside GROUP BY 1, 2)
    SELECT f.* FROM ({{body}}) f
    WHERE NOT (translation IS NOT NULL AND translation = '' AND created_at = {AS_OF} AND EXISTS (
      SELECT 1 FROM names x WHERE x.lang = f.lang AND x.word = f.word AND x.lang <> 'de' AND upper >= 3 AND 100 * upper >= 80 * n))"""


def _words_without_names_sql() -> str:
    ctes, body = _words_from_cards_sql().split("    SELECT lang, word, translation, created_at FROM words", 1)
    return ctes + _without_names_sql().replace("{body}", "SELECT lang, word, translation, created_at FROM words" + body)


@query("words_from_cards_no_names", with_ctes(["cards", "flashcard_tags", "words"], _words_without_names_sql()))
def q_words_from_cards_no_names(spark, sf):
    cards, tags = tb.spread(fx.cards(spark, sf), "id", "answer"), fx.flashcard_tags(spark, sf)
    names = vo.likely_names(vo.word_case_counts(vo.cards_by_language(cards, tags)))
    return vo.words_from_cards(cards, tags, fx.words(spark, sf), as_of(), exclude=names)


# --- the same jobs on tables in hash buckets: one folder read, or only touched folders rewritten


def _card_store(spark, sf) -> CardStore:
    store = CardStore(shared_dir(spark, "card_store"), buckets=STORE_BUCKETS)
    store.save(fx.cards(spark, sf), fx.flashcard_tags(spark, sf))
    return store


def _word_store(spark, sf, stats) -> WordStore:
    store = WordStore(shared_dir(spark, "word_store"), buckets=STORE_BUCKETS)
    store.save(fx.words(spark, sf, stats))
    return store


@query("card_by_id_stored", QUERIES["card_by_id"][1])
def q_card_by_id_stored(spark, sf):
    return joined_tags(_card_store(spark, sf).card_by_id(spark, CARD_BY_ID))


@query("cards_update_stored", QUERIES["cards_update"][1])
def q_cards_update_stored(spark, sf):
    store = _card_store(spark, sf)
    store.update(fx.card_edits(spark, sf), ["edit_no"])
    return joined_tags(co.cards_all(store.cards.read(spark).drop("bucket"), store.tags.read(spark).drop("bucket")))


@query("words_update_stored", QUERIES["words_update"][1])
def q_words_update_stored(spark, sf):
    stats = fx.word_stats(spark, sf)
    store = _word_store(spark, sf, stats)
    store.update(fx.word_edits(spark, sf, stats), ["edit_no"])
    return store.all(spark)


@query("words_delete_stored", QUERIES["words_delete"][1])
def q_words_delete_stored(spark, sf):
    store = _word_store(spark, sf, fx.word_stats(spark, sf))
    store.delete(_benchmark_words(spark, sf))
    return store.all(spark)


# --- 2.6 windows, ordering --------------------------------------------------------------------


@query("schedule_trace", with_ctes(["dedup_reviews", "cards"], f"""
    , based AS (SELECT d.*, c.review_after_secs AS base_secs FROM dedup_reviews d LEFT JOIN cards c
                ON d.card_id = c.id)
    , seg AS (SELECT *, CAST(sum(CASE WHEN remembered THEN 0 ELSE 1 END) OVER (PARTITION BY card_id
                        ORDER BY review_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fails
              FROM based)
    , tr AS (SELECT *, CAST(sum(CASE WHEN remembered THEN 1 ELSE 0 END) OVER (PARTITION BY card_id, fails
                       ORDER BY review_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS streak
             FROM seg)
    SELECT card_id, review_date, remembered, {interval_sql('base_secs', 'fails > 0', 'streak')} AS review_after_secs,
           {due_sql('review_date', interval_sql('base_secs', 'fails > 0', 'streak'))} AS next_due, streak,
           {overflow_sql('base_secs', 'fails > 0', 'streak')} AS overflow
    FROM tr"""))
def q_schedule_trace(spark, sf):
    base = fx.cards(spark, sf).select(F.col("id").alias("card_id"), F.col("review_after_secs").alias("base_secs"))
    return sc.schedule_trace(fx.reviews(spark, sf).join(base, "card_id", "left"))


@query("review_queue", with_ctes(["cards", "flashcard_tags"], f"""
    , due AS (SELECT id, {due_sql('last_reviewed', 'review_after_secs')} AS due_at FROM cards
              WHERE {due_sql('last_reviewed', 'review_after_secs')} < {AS_OF})
    SELECT d.id, d.due_at, t.tag,
           row_number() OVER (PARTITION BY t.tag ORDER BY d.due_at, d.id) AS position,
           count(*) OVER (PARTITION BY t.tag) AS total
    FROM due d JOIN flashcard_tags t ON d.id = t.card_id"""))
def q_review_queue(spark, sf):
    return sc.review_queue(fx.cards(spark, sf), fx.flashcard_tags(spark, sf), as_of())


# --- 2.7 text and scalar functions ------------------------------------------------------------

TAGS_TEXT_SQL = "SELECT doc_id, lang || ' ,' || source || ', ' || lang || ',' AS tags_text FROM documents"


@query("tags_parse", with_ctes([], f"""
    SELECT doc_id, array_to_string({_parse_sql('tags_text')}, '|') AS tags,
           CAST(len({_parse_sql('tags_text')}) AS BIGINT) AS n_tags
    FROM ({TAGS_TEXT_SQL}) x"""))
def q_tags_parse(spark, sf):
    d = tb.read_table(spark, sf, "documents", ["doc_id", "lang", "source"])
    text = F.concat("lang", F.lit(" ,"), "source", F.lit(", "), "lang", F.lit(","))
    t = d.select("doc_id", tx.tags_parse(text).alias("t"))
    return t.select("doc_id", F.array_join("t", "|").alias("tags"), F.size("t").cast("long").alias("n_tags"))


def _xml_sql(x: str, tag: str) -> str:
    o, c = f"<{tag}>", f"</{tag}>"
    s, e = f"strpos({x}, '{o}')", f"strpos({x}, '{c}')"
    return (f"(CASE WHEN {s} > 0 AND {e} > 0 AND {e} >= {s} + {len(o)} "
            f"THEN {utrim(f'substr({x}, {s} + {len(o)}, {e} - {s} - {len(o)})')} END)")


XML_TAGS = ["title", "h1", "article", "p"]


@query("xml_tag_extract", with_ctes([], f"""
    SELECT page_id, {", ".join(f"{_xml_sql('html', t)} AS {t}" for t in XML_TAGS)} FROM pages"""))
def q_xml_tag_extract(spark, sf):
    r = fx.responses(spark, sf)
    return r.select("page_id", *[tx.xml_tag_extract("body", t).alias(t) for t in XML_TAGS])


def _words_block_sql(x: str) -> str:
    block = f"coalesce({_xml_sql(x, 'words')}, '')"
    return f"list_filter(list_transform(string_split({block}, chr(10)), lambda l: {utrim('l')}), lambda w: w <> '')"


@query("response_words", with_ctes([], f"""
    SELECT item_id, pos, word FROM (
      SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (
        SELECT item_id, {_words_block_sql('body')} AS ws FROM (
          SELECT item_id, 'Here:' || chr(10) || '<words>' || chr(10) || replace(text, ' ', chr(10))
                 || chr(10) || '</words>' AS body FROM benchmark) b) c) d"""))
def q_response_words(spark, sf):
    r = fx.word_list_responses(spark, sf)
    return r.select("item_id", F.posexplode(tx.response_words("body")).alias("pos", "word")).withColumn(
        "pos", F.col("pos").cast("long"))


def _sentence_response(first_line, first_word, reversed_word, doc) -> F.Column:
    return F.concat(
        F.lit("Sure!\n<new_sentence>\n "), first_line, F.lit(" \n</new_sentence>\n<new_word>"), first_word,
        F.lit("</new_word>\n"),
        F.when(doc % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<translation> "), reversed_word,
                                                          F.lit(" </translation>"))))


@query("response_sentence", with_ctes([], f"""
    SELECT doc_id, {_xml_sql('body', 'new_sentence')} AS text, {_xml_sql('body', 'new_word')} AS new_word,
           {_xml_sql('body', 'translation')} AS translation,
           CASE WHEN {_xml_sql('body', 'new_sentence')} IS NULL OR {_xml_sql('body', 'new_word')} IS NULL
                  OR {_xml_sql('body', 'translation')} IS NULL THEN 'quarantined' ELSE 'accepted' END AS status
    FROM (SELECT doc_id, 'Sure!' || chr(10) || '<new_sentence>' || chr(10) || ' ' || text
                 || ' ' || chr(10) || '</new_sentence>' || chr(10) || '<new_word>' || split_part(text, ' ', 1)
                 || '</new_word>' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN ''
                 ELSE '<translation> ' || reverse(split_part(text, ' ', 1)) || ' </translation>' END AS body
          FROM documents) r"""))
def q_response_sentence(spark, sf):
    d = tb.read_table(spark, sf, "documents", ["doc_id", "text"])
    first_word = F.substring_index("text", " ", 1)
    body = _sentence_response(F.col("text"), first_word, F.reverse(first_word), F.col("doc_id"))
    s = d.select("doc_id", tx.response_sentence(body).alias("s"))
    ok = F.col("s.text").isNotNull() & F.col("s.new_word").isNotNull() & F.col("s.translation").isNotNull()
    return s.select("doc_id", "s.text", "s.new_word", "s.translation",
                    F.when(ok, F.lit("accepted")).otherwise(F.lit("quarantined")).alias("status"))


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DICT_CHUNK_WORDS = 500


def _dict_chunks_sql() -> str:
    return f"""
    SELECT lang, CAST(floor((position - 1) / {DICT_CHUNK_WORDS}) AS BIGINT) + 1 AS part,
           CAST(ceil(any_value(n) / {DICT_CHUNK_WORDS}) AS BIGINT) AS n_parts,
           string_agg(word, chr(10) ORDER BY word) AS dict, any_value({lang_name_sql('lang')}) AS language
    FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) AS position,
                 count(*) OVER (PARTITION BY lang) AS n FROM words) r
    GROUP BY lang, part"""


def _fill_sql(template: str, **values) -> str:
    out = _sql_literal(template)
    for k, v in values.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


def _with_dictionary_sql(template: str) -> str:
    filled = _fill_sql(template, lang="language", part="CAST(part AS VARCHAR)", n_parts="CAST(n_parts AS VARCHAR)", dict="dict")
    return f"SELECT lang, part, n_parts, {filled} AS prompt FROM ({_dict_chunks_sql()}) c"


def _dict_chunks(spark, sf) -> DataFrame:
    return pr.dictionary_chunks(fx.words(spark, sf), _lang_name, DICT_CHUNK_WORDS)


@query("prompt_sentence", with_ctes(["words"], _with_dictionary_sql(pr.PROMPT_SENTENCE)))
def q_prompt_sentence(spark, sf):
    return pr.prompt_sentence(_dict_chunks(spark, sf))


@query("prompt_story", with_ctes(["words"], _with_dictionary_sql(pr.PROMPT_STORY)))
def q_prompt_story(spark, sf):
    return pr.prompt_story(_dict_chunks(spark, sf))


@query("prompt_words", with_ctes(["cards", "flashcard_tags"], f"""
    SELECT tag, chunk, {_fill_sql(pr.PROMPT_WORDS, lang='tag', sentences='corpus')} AS prompt
    FROM ({CORPUS_SQL}) c"""))
def q_prompt_words(spark, sf):
    return pr.prompt_words(st.sentences_corpus(fx.cards(spark, sf), fx.flashcard_tags(spark, sf)))


@query("story_tokens", with_ctes(["doc_tokens"], """
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(word_no AS BIGINT) AS word_no, token FROM doc_tokens"""))
def q_story_tokens(spark, sf):
    t = mi.story_tokens(fx.documents(spark, sf, ("doc_id", "text"), streamed=True))
    return t.select("doc_id", F.col("line_no").cast("long"), F.col("word_no").cast("long"), "token")


@query("word_normalise", with_ctes(["doc_words"], """
    SELECT lang, word, count(*) AS n FROM doc_words GROUP BY lang, word"""))
def q_word_normalise(spark, sf):
    return fx.word_stats(spark, sf).select("lang", "word", F.col("n_occurrences").alias("n"))


def _rich_text_sql() -> str:
    """The segmenter in DuckDB, written out from the rules.

    Documents have no backtick, so the blocks of each of the fixture's six shapes are known by the rules: an
    opener ends the raw text before it, a backtick ends the body, and a backtick right before an opener breaks it.
    """
    return """WITH inp AS (
      SELECT doc_id, doc_id % 6 AS shape, text AS first, n_chars || '/' || (doc_id + 1) AS x FROM documents),
    blocks AS (
      SELECT doc_id, unnest(CASE shape
        WHEN 0 THEN [{'kind': 'raw', 'text': first || ' ' || x}]
        WHEN 1 THEN [{'kind': 'raw', 'text': first || ' What is '}, {'kind': 'math', 'text': x}, {'kind': 'raw', 'text': ' ?'}]
        WHEN 2 THEN [{'kind': 'raw', 'text': ''}, {'kind': 'math', 'text': x}, {'kind': 'raw', 'text': ' ' || first}]
        WHEN 3 THEN [{'kind': 'raw', 'text': first || ' a '}, {'kind': 'math', 'text': x}]
        WHEN 4 THEN [{'kind': 'raw', 'text': first || ' a ``math ' || x || '`'}]
        ELSE [{'kind': 'raw', 'text': ''}, {'kind': 'math', 'text': ''}, {'kind': 'raw', 'text': ' ' || first || ' '},
              {'kind': 'math', 'text': x}] END) AS b,
        generate_subscripts(CASE shape WHEN 0 THEN [0] WHEN 4 THEN [0] WHEN 3 THEN [0, 0]
                            WHEN 5 THEN [0, 0, 0, 0] ELSE [0, 0, 0] END, 1) - 1 AS block_no
      FROM inp)
    SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, b.kind AS kind, b.text AS text FROM blocks"""


@query("rich_text_blocks", _rich_text_sql())
def q_rich_text_blocks(spark, sf):
    r = fx.rich_text_input(spark, sf)
    b = r.select("doc_id", F.posexplode(tx.rich_text_blocks("text")).alias("block_no", "b"))
    return b.select("doc_id", F.col("block_no").cast("long"), "b.kind", "b.text")


@query("language_code", with_ctes(["flashcard_tags"], f"""
    SELECT card_id, tag, {lang_code_sql('tag')} AS code FROM flashcard_tags"""))
def q_language_code(spark, sf):
    return fx.flashcard_tags(spark, sf).select("card_id", "tag", tx.language_code("tag").alias("code"))


@query("year_month", with_ctes(["reviews_big"], """
    SELECT strftime(review_date, '%Y-%m') AS year_month, count(*) AS n_reviews FROM reviews_big GROUP BY 1"""))
def q_year_month(spark, sf):
    return fx.reviews_big(spark, sf).groupBy(tx.year_month("review_date").alias("year_month")).agg(
        F.count(F.lit(1)).alias("n_reviews"))


@query("due_at", with_ctes(["cards"], f"""
    SELECT id, last_reviewed, review_after_secs, {due_sql('last_reviewed', 'review_after_secs')} AS due_at
    FROM cards"""))
def q_due_at(spark, sf):
    c = fx.cards(spark, sf)
    return c.select("id", "last_reviewed", "review_after_secs", tx.due_at("last_reviewed", "review_after_secs").alias(
        "due_at"))


# --- 2.8 corpus mining -------------------------------------------------------------------------


@query("new_word_sentences", with_ctes(["new_word_sentences"], "SELECT * FROM new_word_sentences"))
def q_new_word_sentences(spark, sf):
    return _mined(spark, sf).select("doc_id", "lang", F.col("line_no").cast("long"), "sentence",
                                    F.col("n_words").cast("long"), "new_word")


@query("new_word_sentences_by_set", QUERIES["new_word_sentences"][1])
def q_new_word_sentences_by_set(spark, sf):
    mined = mi.new_word_sentences(fx.documents(spark, sf), fx.words(spark, sf), by_id_set=True)
    return mined.select("doc_id", "lang", F.col("line_no").cast("long"), "sentence", F.col("n_words").cast("long"), "new_word")


@query("next_words", with_ctes(["new_word_sentences"], f"""
    SELECT lang, new_word, count(*) AS n_sentences FROM new_word_sentences GROUP BY lang, new_word
    ORDER BY n_sentences DESC, lang, new_word LIMIT {NEXT_WORDS_K}"""))
def q_next_words(spark, sf):
    return mi.next_words(_mined(spark, sf), NEXT_WORDS_K)


def _expansion_sql(steps: int) -> str:
    """The greedy choice, step by step; ``learnt`` holds each language's words so far."""
    ctes = [f"""
    , lacking AS MATERIALIZED (
      SELECT lang, list(word) AS unknown FROM (
        SELECT e.* FROM (SELECT doc_id, lang, line_no, unnest(words) AS word FROM sentence_lines
                         WHERE len(words) BETWEEN 3 AND 12 AND NOT list_contains(['hola', 'hello', 'bonjour', 'hallo'], words[1])) e
        LEFT JOIN words w ON e.lang = w.lang AND e.word = w.word WHERE w.word IS NULL)
      GROUP BY lang, doc_id, line_no)
    , learnt0 AS MATERIALIZED (SELECT DISTINCT lang, []::VARCHAR[] AS known FROM lacking)"""]
    for i in range(1, steps + 1):
        ctes.append(f"""
    , pick{i} AS MATERIALIZED (
      SELECT lang, word, count(*) AS n FROM (
        SELECT lang, list_filter(unknown, lambda x: NOT list_contains(known, x)) AS rest FROM lacking JOIN learnt{i - 1} USING (lang)),
        LATERAL (SELECT rest[1] AS word) t
      WHERE len(rest) = 1 AND NOT list_contains({articles_sql('lang')}, word) GROUP BY lang, word
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) = 1)
    , learnt{i} AS MATERIALIZED (
      SELECT l.lang, CASE WHEN p.word IS NULL THEN known ELSE list_append(known, p.word) END AS known
      FROM learnt{i - 1} l LEFT JOIN pick{i} p USING (lang))""")
    picks = " UNION ALL ".join(f"SELECT lang, {i} AS step, word, n FROM pick{i}" for i in range(1, steps + 1))
    return "".join(ctes) + f"""
    SELECT lang, CAST(step AS INTEGER) AS step, word, n AS n_unlocked,
           CAST(sum(n) OVER (PARTITION BY lang ORDER BY step) AS BIGINT) AS n_readable FROM ({picks}) p"""


@query("next_words_plan", with_ctes(["sentence_lines", "words"], _expansion_sql(EXPANSION_STEPS)))
def q_next_words_plan(spark, sf):
    docs = fx.documents(spark, sf)
    return mi.expansion_plan(docs, tb.materialize(fx.words(spark, sf), "vocabulary"), EXPANSION_STEPS)
