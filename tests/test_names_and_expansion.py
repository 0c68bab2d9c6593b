"""Names left out of a vocabulary, and the order in which to learn words, against plain models."""

import random
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from recall.operators import mining as mi
from recall.operators import vocab as vo
from recall.plans.queries import QUERIES
from recall.schema import WORD
from recall.sources import fixtures as fx
from tests.conftest import SF001

CARDS = [
    ("es", "Ayer Marta vino a casa.\nHoy vino Marta con el perro.\nLa casa de Marta es grande."),
    ("es", "En Madrid llueve. Casa nueva, dice «Marta».\nEn Madrid hay sol; Madrid es grande"),
    ("es", "Vamos a Madrid! Casa y perro. El perro de Marta. Perro\nMarta\nmadrid"),
    ("en", "we saw Paris and paris and PARIS"),
    ("de", "Das Haus und das Haus und das Haus und Peter"),
]


def store(spark, rows):
    names = {"es": "spanish", "en": "english", "de": "german"}
    cards = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "id long, answer string")
    tags = spark.createDataFrame([(i, names[lang]) for i, (lang, _) in enumerate(rows)] + [(0, "other")], "card_id long, tag string")
    return cards, tags


def plain_counts(rows):
    out = defaultdict(lambda: [0, 0])
    for lang, text in rows:
        for line in text.split("\n"):
            tokens = [t for t in line.split(" ") if regex.search(r"\p{L}", t)]
            for before, t in zip(tokens, tokens[1:]):
                if not regex.search(r"[.!?:…]\P{L}*$", before):
                    word = regex.sub(r"^\P{L}+|\P{L}+$", "", t)
                    out[(lang, word.lower())][0 if regex.match(r"\p{Lu}", word) else 1] += 1
    return {k: tuple(v) for k, v in out.items()}


def counts_of(df):
    return {(r.lang, r.word): (r.n_capital, r.n_lower) for r in df.collect()}


def test_case_counts_and_their_parts_add_up(spark):
    rows = [r for r in CARDS if r[0] != "en"]  # english is no language of the vocabulary's tags
    cards, tags = store(spark, CARDS)
    whole = vo.word_case_counts(vo.cards_by_language(cards, tags))
    assert counts_of(whole) == plain_counts(rows)
    parts = [vo.word_case_counts(vo.cards_by_language(cards.where(f"id % 2 = {k}"), tags)) for k in (0, 1)]
    assert counts_of(vo.merge_case_counts(*parts)) == counts_of(whole)


def test_planted_names_are_left_out(spark):
    cards, tags = store(spark, CARDS)
    names = vo.likely_names(vo.word_case_counts(vo.cards_by_language(cards, tags)), least=3, percent=80)
    assert sorted((r.lang, r.word) for r in names.collect()) == [("es", "madrid"), ("es", "marta")]
    words = spark.createDataFrame([("es", "marta", "known", None)], WORD)
    found = vo.words_from_cards(cards, tags, words, F.lit("2024-01-01").cast("timestamp_ntz"), exclude=names)
    got = {(r.lang, r.word): r.translation for r in found.collect()}
    assert got[("es", "marta")] == "known" and ("es", "madrid") not in got   # a stored word stays
    assert {("es", "casa"), ("es", "perro"), ("de", "haus"), ("de", "peter")} <= set(got)


def test_a_name_needs_both_counts(spark):
    counts = spark.createDataFrame([("es", "a", 2, 0), ("es", "b", 3, 0), ("es", "c", 8, 2), ("es", "d", 7, 2), ("de", "e", 9, 0)],
                                   "lang string, word string, n_capital long, n_lower long")
    assert sorted(r.word for r in vo.likely_names(counts, 3, 80).collect()) == ["b", "c"]


def plain_plan(docs, vocab, steps):
    """The greedy choice over all sentences, every count made anew at every step."""
    sentences = defaultdict(list)
    for lang, text in docs:
        for line in text.split("\n"):
            words = list(dict.fromkeys(w for w in (regex.sub(r"^\P{L}+|\P{L}+$", "", t).lower() for t in line.split(" ")) if w))
            if 3 <= len(words) <= 12 and words[0] not in ("hola", "hello", "bonjour", "hallo"):
                sentences[lang].append(set(words) - {w for x, w in vocab if x == lang})
    plan = set()
    for lang, open_ in sentences.items():
        learnt, readable = set(), 0
        for step in range(1, steps + 1):
            counts = Counter()
            for s in open_:
                rest = s - learnt
                if len(rest) == 1:
                    counts.update(rest)
            counts = {w: n for w, n in counts.items() if w not in vo.ARTICLES.get(lang, ())}
            if not counts:
                break
            word = min(counts, key=lambda w: (-counts[w], w))
            readable += counts[word]
            plan.add((lang, step, word, counts[word], readable))
            learnt.add(word)
    return plan


@pytest.mark.parametrize("seed", [1, 2])
def test_expansion_plan_is_the_greedy_choice(spark, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"
    docs = [(rng.choice(["es", "fr"]), "\n".join(" ".join(rng.choice(letters) * 2 for _ in range(rng.randint(2, 7))) for _ in range(20)) + "\nel la un le les des\nHola aa bb cc")
            for _ in range(15)]
    vocab = [(lang, c * 2) for lang in ("es", "fr") for c in letters[:7]]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string")
    words = spark.createDataFrame([(lang, w, "", None) for lang, w in vocab] + [("es", "aa", None, None)], WORD)
    for steps in (1, 4, 12):
        got = {tuple(r) for r in mi.expansion_plan(df, words, steps).select("lang", "step", "word", "n_unlocked", "n_readable").collect()}
        assert got == plain_plan(docs, vocab, steps)


def test_expansion_plan_of_the_test_corpus(spark):
    docs = [(r.lang, r.text) for r in fx.documents(spark, SF001).collect()]
    vocab = {(r.lang, r.word) for r in fx.words(spark, SF001).collect()}
    got = {tuple(r) for r in QUERIES["next_words_plan"][0](spark, SF001).select("lang", "step", "word", "n_unlocked", "n_readable").collect()}
    assert got == plain_plan(docs, vocab, 6) and got


def test_expansion_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert mi.expansion_plan(docs, spark.createDataFrame([], WORD), 3).collect() == []
