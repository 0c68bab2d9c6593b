"""The same queries as ANSI SQL for DuckDB, over the raw test tables.

Each query is a WITH list of the fixture derivations it needs followed by its
body, so the cross-check shares nothing with the Spark code but the rules.
"""

from __future__ import annotations

# --- fixed values, written out here and not taken from the engine, so that a wrong one there shows ---
FIRST_INTERVAL_SECS, FAIL_INTERVAL_SECS = 43200, 21600
MIN_WORDS, MAX_WORDS = 3, 12
GREETINGS = ["hola", "hello", "bonjour", "hallo"]
ARTICLES = {
    "de": ["ein", "eine", "einen", "einem", "einer", "eines", "der", "die", "das", "den", "dem", "des"],
    "en": ["the", "a", "an"],
    "es": ["un", "una", "unos", "unas", "el", "la", "los", "las"],
    "fr": ["un", "une", "des", "le", "la", "les", "l"],
    "pt-PT": ["um", "uma", "uns", "umas", "o", "a", "os", "as"],
}
LANGUAGE_CODES = {"german": "de", "french": "fr", "spanish": "es", "portuguese": "pt-PT"}
DOC_LANGUAGE_NAMES = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}
WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ANSWERS_FROM, DEFAULT_AS_OF, VOCABULARY_MIN_DOCS = "2024-01-30 00:00:00", "2024-01-20 00:00:00", 10

AS_OF = f"TIMESTAMP '{DEFAULT_AS_OF}'"
TRIM = f"'^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$'"
NORM = r"'^[^\p{L}]+|[^\p{L}]+$'"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, {TRIM}, '', 'g')"


def norm(x: str) -> str:
    return f"lower(regexp_replace({x}, {NORM}, '', 'g'))"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def articles_sql(lang: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in ARTICLES.items())
    return f"(CASE {lang} {whens} ELSE []::VARCHAR[] END)"


def lang_name_sql(code: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOC_LANGUAGE_NAMES.items())
    return f"(CASE {code} {whens} END)"


def lang_code_sql(name: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_CODES.items())
    return f"(CASE {name} {whens} END)"


def _doubled_sql(base: str, failed: str, streak: str) -> str:
    """The exact interval; an integer of 128 bits holds every one that could still fit 64."""
    start = f"(CASE WHEN {failed} THEN {FAIL_INTERVAL_SECS} ELSE {base} END)"
    return f"CAST({start} AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(LEAST({streak}, 63) AS INTEGER))"


def interval_sql(base: str, failed: str, streak: str) -> str:
    return f"TRY_CAST({_doubled_sql(base, failed, streak)} AS BIGINT)"


def overflow_sql(base: str, failed: str, streak: str) -> str:
    return f"coalesce({_doubled_sql(base, failed, streak)} > 9223372036854775807, false)"


def due_sql(ts: str, secs: str) -> str:
    left = f"date_diff('second', {ts}, TIMESTAMP '9999-12-31 23:59:59')"
    return f"(CASE WHEN {secs} <= {left} THEN {ts} + to_seconds({secs}) END)"


def distinct_ordered(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


CTES: dict[str, tuple[list[str], str]] = {
    "cards": ([], f"""
    SELECT doc_id AS id, split_part(text, chr(10), 1) AS question, text AS answer,
           CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '' END AS examples, source,
           CASE WHEN doc_id % 5 = 0 THEN 'doc_' || doc_id || '.png' END AS img,
           CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) AS last_reviewed,
           CAST({FIRST_INTERVAL_SECS} AS BIGINT) << CAST(doc_id % 6 AS INTEGER) AS review_after_secs,
           CASE WHEN doc_id % 7 = 0 THEN 'q_' || doc_id || '.png' END AS question_img
    FROM documents"""),
    "flashcard_tags": ([], f"""
    SELECT DISTINCT card_id, tag FROM (
      SELECT doc_id AS card_id,
             unnest([{lang_name_sql('lang')}, source,
                     CASE WHEN doc_id % 10 = 3 THEN 'a,b' END,
                     CASE WHEN doc_id % 10 = 4 THEN '' END]) AS tag
      FROM documents WHERE doc_id % 10 <> 9) t
    WHERE tag IS NOT NULL"""),
    "tag_groups": (["flashcard_tags"], """
    SELECT card_id, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n_tags
    FROM flashcard_tags GROUP BY card_id"""),
    "cards_all": (["cards", "tag_groups"], """
    SELECT c.*, g.tags FROM cards c JOIN tag_groups g ON c.id = g.card_id"""),
    "reviews": ([], """
    SELECT user_id AS card_id, ts AS review_date, event_type IN ('view', 'click', 'purchase') AS remembered
    FROM events"""),
    "reviews_big": ([], """
    SELECT l_partkey AS card_id, l_shipdate AS review_date, bool_and(l_returnflag <> 'R') AS remembered
    FROM lineitem GROUP BY l_partkey, l_shipdate"""),
    "doc_words": ([], f"""
    SELECT doc_id, lang, w AS word FROM (
      SELECT doc_id, lang, {norm('t')} AS w
      FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[ \\n]')) AS t FROM documents))
    WHERE w <> ''"""),
    "words": (["doc_words"], f"""
    SELECT lang, word,
           CASE length(word) % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE reverse(word) END AS translation,
           TIMESTAMP '2024-01-01 00:00:00' AS created_at
    FROM doc_words GROUP BY lang, word HAVING count(DISTINCT doc_id) >= {VOCABULARY_MIN_DOCS}"""),
    "dictionary": (["doc_words"], """
    SELECT DISTINCT lang, word, lang || ':' || word AS translation FROM doc_words WHERE length(word) % 2 = 0"""),
    "doc_lines": ([], """
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
    FROM documents"""),
    "doc_tokens": (["doc_lines"], """
    SELECT doc_id, lang, line_no, word_no,
           piece || CASE WHEN word_no < n - 1 THEN ' ' ELSE '' END AS token, piece
    FROM (SELECT doc_id, lang, line_no, len(string_split(line, ' ')) AS n,
                 unnest(string_split(line, ' ')) AS piece,
                 generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no
          FROM doc_lines)
    WHERE piece || CASE WHEN word_no < n - 1 THEN ' ' ELSE '' END <> ''"""),
    "sentence_lines": (["doc_lines"], f"""
    SELECT doc_id, lang, line_no, line, {distinct_ordered('l')} AS words
    FROM (SELECT doc_id, lang, line_no, line,
                 list_filter(list_transform(string_split(line, ' '), lambda x: {norm('x')}), lambda x: x <> '') AS l
          FROM doc_lines)"""),
    "new_word_sentences": (["sentence_lines", "words"], f"""
    SELECT doc_id, lang, line_no, sentence, n_words, new_word FROM (
      SELECT e.doc_id, e.lang, e.line_no, any_value(e.line) AS sentence, any_value(e.n_words) AS n_words,
             count(*) FILTER (WHERE w.word IS NULL) AS n_unknown,
             max(CASE WHEN w.word IS NULL THEN e.word END) AS new_word
      FROM (SELECT doc_id, lang, line_no, line, CAST(len(words) AS BIGINT) AS n_words, unnest(words) AS word
            FROM sentence_lines
            WHERE len(words) BETWEEN {MIN_WORDS} AND {MAX_WORDS}
              AND NOT list_contains({sql_list(GREETINGS)}, words[1])) e
      LEFT JOIN words w ON e.lang = w.lang AND e.word = w.word
      GROUP BY e.doc_id, e.lang, e.line_no) s
    WHERE n_unknown = 1 AND NOT list_contains({articles_sql('lang')}, new_word)"""),
    "dedup_big": (["reviews_big"], """
    SELECT card_id, review_date, bool_and(remembered) AS remembered FROM reviews_big GROUP BY card_id, review_date"""),
    "dedup_reviews": (["reviews"], """
    SELECT card_id, review_date, bool_and(remembered) AS remembered FROM reviews GROUP BY card_id, review_date"""),
}


def with_ctes(needed: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    return f"WITH {parts}\n{body.strip()}"


def replay_sql(dedup: str) -> str:
    """Per-card (last_fail, last_review, n_reviews, streak) over a de-duplicated log."""
    return f"""
    SELECT p.card_id, p.last_fail, p.last_review, p.n_reviews,
           count(*) FILTER (WHERE d.remembered AND (p.last_fail IS NULL OR d.review_date > p.last_fail)) AS streak
    FROM (SELECT card_id, max(CASE WHEN NOT remembered THEN review_date END) AS last_fail,
                 max(review_date) AS last_review, count(*) AS n_reviews
          FROM {dedup} GROUP BY card_id) p
    JOIN {dedup} d ON p.card_id = d.card_id
    GROUP BY p.card_id, p.last_fail, p.last_review, p.n_reviews"""


def state_with_cards_sql(dedup: str, cards: str) -> str:
    return f"""
    SELECT c.id AS card_id, coalesce(s.last_review, c.last_reviewed) AS last_reviewed,
           CASE WHEN s.n_reviews IS NULL THEN c.review_after_secs
                ELSE {interval_sql('c.review_after_secs', 's.last_fail IS NOT NULL', 's.streak')} END
             AS review_after_secs,
           coalesce(s.n_reviews, 0) AS n_reviews, coalesce(s.streak, 0) AS streak,
           s.n_reviews IS NOT NULL AND {overflow_sql('c.review_after_secs', 's.last_fail IS NOT NULL', 's.streak')} AS overflow
    FROM {cards} c LEFT JOIN ({replay_sql(dedup)}) s ON c.id = s.card_id"""


ANSWERS_SQL = f"""
    SELECT CASE c WHEN 2 THEN -1 - user_id ELSE user_id END AS card_id,
           CASE c WHEN 3 THEN first_ts ELSE ts END AS answered_at,
           CASE WHEN c IN (1, 3) THEN 'n' WHEN event_type IN ('view', 'click', 'purchase') THEN 'y'
                WHEN event_type = 'error' THEN 'n' ELSE '?' END AS answer
    FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events) e, range(4) t(c)
    WHERE ts >= TIMESTAMP '{ANSWERS_FROM}'
      AND (c = 0 OR (c = 1 AND user_id % 3 = 0) OR (c = 2 AND user_id % 4 = 0) OR (c = 3 AND user_id % 5 = 0))"""
