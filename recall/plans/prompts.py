"""Prompt texts filled from vocabulary and corpus tables (our own wording)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.operators.ordering import rank_within

# The placeholders and the answer tags are fixed values: the parsers of ``functions.text`` read them.
PROMPT_SENTENCE = """Task: teach me one more {lang} word. My own language is English.
Vocabulary (part {part} of {n_parts} of all words that I can read):
<dictionary>
{dict}
</dictionary>
Reply with a short {lang} sentence. Exactly one of its words is missing from my vocabulary; every other one is in it.
Choose no article as that word and do not start by greeting anyone. Use these tags and nothing else:
<new_sentence></new_sentence> for the sentence, <new_word></new_word> for the added word,
<translation></translation> for the sentence in English.
"""

PROMPT_WORDS = """Task: collect vocabulary from {lang} text that I have read.
<sentences>
{sentences}
</sentences>
Reply with the distinct words of the text in lower case, each on a line of its own, between <words> and </words>.
Skip articles and anything that names a person or a place.
"""

PROMPT_STORY = """Task: a short {lang} story for a learner.
Vocabulary (part {part} of {n_parts} of all words that the learner can read):
<dictionary>
{dict}
</dictionary>
Tell the story with words of this vocabulary, as many of them as you like. Reply with nothing but the story.
"""


def fill(template: str, **values) -> F.Column:
    out = F.lit(template)
    for key, col in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), col)
    return out


def dictionary_chunks(words: DataFrame, language_name, chunk_words: int) -> DataFrame:
    """(lang, part, n_parts, n_words, dict): each language's words, sorted, newline-joined, ``chunk_words`` a part.

    A prompt says which part of how many its list is; the parts together are the whole vocabulary.
    """
    ranked = rank_within(words.select("lang", "word"), ["lang"], ["word"], total="n_all")
    part = F.floor((F.col("position") - 1) / F.lit(chunk_words)).cast("long") + 1
    grouped = ranked.groupBy("lang", part.alias("part")).agg(
        F.array_sort(F.collect_list("word")).alias("_w"), F.max("n_all").alias("_n"))
    return grouped.select("lang", "part", F.ceil(F.col("_n") / F.lit(chunk_words)).cast("long").alias("n_parts"),
                          F.size("_w").cast("long").alias("n_words"),
                          F.array_join("_w", "\n").alias("dict"), language_name(F.col("lang")).alias("language"))


def _with_dictionary(chunks: DataFrame, template: str) -> DataFrame:
    prompt = fill(template, lang=F.col("language"), part=F.col("part").cast("string"),
                  n_parts=F.col("n_parts").cast("string"), dict=F.col("dict"))
    return chunks.select("lang", "part", "n_parts", prompt.alias("prompt"))


def prompt_sentence(chunks: DataFrame) -> DataFrame:
    return _with_dictionary(chunks, PROMPT_SENTENCE)


def prompt_story(chunks: DataFrame) -> DataFrame:
    return _with_dictionary(chunks, PROMPT_STORY)


def prompt_words(corpus: DataFrame) -> DataFrame:
    """One prompt per corpus chunk of a language."""
    return corpus.select("tag", "chunk", fill(PROMPT_WORDS, lang=F.col("tag"), sentences=F.col("corpus")).alias(
        "prompt"))
