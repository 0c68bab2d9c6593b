import datetime as dt

from pyspark.sql import functions as F

from recall.operators import mining as mi
from recall.operators import vocab as vo
from recall.operators.ordering import rank_within
from recall.schema import WORD

T0 = dt.datetime(2024, 1, 1)


def _words(spark, rows):
    return spark.createDataFrame([(lang, w, t, T0) for lang, w, t in rows], WORD)


def test_null_translation_is_miss_empty_is_hit(spark):
    words = _words(spark, [("es", "casa", None), ("es", "perro", ""), ("es", "gato", "cat")])
    dictionary = spark.createDataFrame([("es", "casa", "HOUSE"), ("es", "perro", "DOG")], "lang string, word string, "
                                                                                        "translation string")
    tokens = spark.createDataFrame([("es", w) for w in ["casa", "perro", "gato", "sol"]], "lang string, word string")
    got = {r.word: (r.translation, r.resolved_by) for r in vo.word_lookup_fallback(tokens, words, dictionary).collect()}
    assert got == {"casa": ("HOUSE", "dictionary"), "perro": ("", "vocabulary"), "gato": ("cat", "vocabulary"),
                   "sol": (None, None)}
    hits = {r.word: r.hit for r in vo.word_lookup(tokens, words).collect()}
    assert hits == {"casa": False, "perro": True, "gato": True, "sol": False}


def test_add_new_keeps_first_row(spark):
    words = _words(spark, [("es", "casa", "house")])
    new = spark.createDataFrame([("es", "casa", "X", 1), ("es", "sol", "second", 2), ("es", "sol", "first", 1)],
                                "lang string, word string, translation string, seq int")
    got = {r.word: r.translation for r in vo.words_add_new(words, new, ["seq"], F.lit(T0)).collect()}
    assert got == {"casa": "house", "sol": "first"}


def test_update_and_delete(spark):
    words = _words(spark, [("es", "casa", None), ("es", "sol", "sun")])
    edits = spark.createDataFrame([("es", "casa", "house"), ("es", "nada", "x")], "lang string, word string, "
                                                                                "translation string")
    assert {r.word: r.translation for r in vo.words_update(words, edits).collect()} == {"casa": "house", "sol": "sun"}
    keys = spark.createDataFrame([("es", "sol"), ("fr", "casa")], "lang string, word string")
    assert [r.word for r in vo.words_delete(words, keys).collect()] == ["casa"]


def test_rank_within_equals_row_number(spark):
    rows = [(g, k) for g in ["a", "b", "c"] for k in range(200 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = {(r.g, r.k): (r.position, r.total) for r in rank_within(df, ["g"], ["k"], num_partitions=5).collect()}
    assert all(got[(g, k)] == (k + 1, 200 if g == "a" else 7) for g, k in rows)


def test_story_tokens_keep_spaces(spark):
    docs = spark.createDataFrame([(1, "a  b \n\nc")], "doc_id long, text string")
    got = [(r.line_no, r.word_no, r.token) for r in mi.story_tokens(docs).collect()]
    assert got == [(0, 0, "a "), (0, 1, " "), (0, 2, "b "), (2, 0, "c")]


def _brute_force_sentences(docs, vocab):
    out = set()
    for doc_id, lang, text in docs:
        for line_no, line in enumerate(text.split("\n")):
            words = []
            for t in line.split(" "):
                w = t.strip(".,!?¡¿;:'\"").lower()
                if w and w not in words:
                    words.append(w)
            if not (mi.MIN_WORDS <= len(words) <= mi.MAX_WORDS) or words[0] in mi.GREETINGS:
                continue
            unknown = [w for w in words if (lang, w) not in vocab]
            if len(unknown) == 1 and unknown[0] not in vo.ARTICLES.get(lang, []):
                out.add((doc_id, line_no, unknown[0]))
    return out


def test_new_word_sentences_brute_force(spark):
    docs = [(1, "es", "el perro come pan.\nHola amigo mío y tú\nla casa es roja y grande"),
            (2, "es", "yo veo el sol\nuna dos tres cuatro cinco seis siete ocho nueve diez once doce trece"),
            (3, "en", "the cat eats fish\nthe dog eats a bone")]
    vocab = {("es", w) for w in ["el", "perro", "come", "casa", "es", "roja", "y", "yo", "veo", "sol", "amigo",
                                 "mío", "tú", "la"]} | {("en", w) for w in ["cat", "eats", "dog", "a", "the"]}
    words = _words(spark, [(lang, w, None) for lang, w in vocab])
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {(r.doc_id, r.line_no, r.new_word) for r in mi.new_word_sentences(df, words).collect()}
    assert got == _brute_force_sentences(docs, vocab)
    assert got == {(1, 0, "pan"), (1, 2, "grande"), (3, 0, "fish"), (3, 1, "bone")}


def test_vocabulary_coverage(spark):
    docs = spark.createDataFrame([(1, "es", "casa casa Sol\nluna")], "doc_id long, lang string, text string")
    words = _words(spark, [("es", "casa", None), ("es", "sol", "")])
    r = mi.vocabulary_coverage(docs, words).collect()[0]
    assert (r.n_tokens, r.n_known, r.n_distinct, r.n_distinct_known) == (4, 3, 3, 2)
    assert r.known_share == 0.75


def test_story_drafts_and_word_exclusion(spark):
    from recall.operators.cards import drafts_from_sentences
    from recall.schema import CARD, CARD_TAG
    s = spark.createDataFrame([("Hola amigo", "Hello friend", "spanish")], "text string, translation string, "
                                                                          "language string")
    d = drafts_from_sentences(s, F.lit(T0).cast("timestamp_ntz"), from_story=True).collect()[0]
    assert (d.question, d.answer, d.tags, d.source) == ("Hello friend", "Hola amigo", ["spanish"],
                                                        "learning-languages app")
    cards = spark.createDataFrame([(1, "q", "El perro de Juan", None, None, None, T0, 43200, None)], CARD)
    tags = spark.createDataFrame([(1, "spanish")], CARD_TAG)
    names = spark.createDataFrame([("es", "juan")], "lang string, word string")
    got = {(r.word, r.translation) for r in vo.words_from_cards(cards, tags, _words(spark, []), F.lit(T0),
                                                                exclude=names).collect()}
    assert got == {("perro", ""), ("de", "")}  # article and excluded name left out
