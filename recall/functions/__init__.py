"""Column -> Column expressions; all JVM-side, no Python UDFs."""

from recall.functions.text import (  # noqa: F401
    due_at,
    interval_after,
    language_code,
    response_sentence,
    response_words,
    rich_text_blocks,
    tags_parse,
    unicode_trim,
    word_normalise,
    xml_tag_extract,
    year_month,
)
