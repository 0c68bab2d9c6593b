"""Recall: spaced-repetition learning data as Spark DataFrames.

Cards, tags, vocabularies and an append-only review history are plain
DataFrames; every operator is a function ``DataFrame(s) -> DataFrame``
built from native Spark expressions. Time enters only as an ``as_of``
argument so results are repeatable.

The most used operators are importable from the package root::

    from recall import cards_all, cards_due, schedule_state, new_word_sentences
"""

__version__ = "0.1.0"

from recall.operators.cards import (  # noqa: E402,F401
    card_by_id, card_count, card_listing, card_media_links, cards_all, cards_by_tag, cards_due,
    reviews_quarantine, tags_by_card, tags_quarantine,
)
from recall.operators.idsets import accepted_by_set, id_set, mark_known_by_set, with_membership  # noqa: E402,F401
from recall.operators.maintenance import cards_add, cards_update  # noqa: E402,F401
from recall.operators.mining import (  # noqa: E402,F401
    expansion_plan, new_word_sentences, next_words, reading_list, story_tokens, vocabulary_coverage,
)
from recall.operators.ordering import first_within, rank_within  # noqa: E402,F401
from recall.operators.schedule import (  # noqa: E402,F401
    answers_quarantine, replay, review_queue, reviews_apply, schedule_state, schedule_trace,
)
from recall.operators.stats import avg_reviews_per_month, sentences_corpus, word_count  # noqa: E402,F401
from recall.operators.vocab import (  # noqa: E402,F401
    likely_names, merge_case_counts, word_case_counts, word_lookup, word_lookup_fallback, words_add_new, words_delete, words_from_cards, words_update,
)
