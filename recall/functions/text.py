"""Scalar text and time expressions of the card store.

Every function takes and returns ``pyspark.sql.Column`` so it composes into
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from recall.schema import FAIL_INTERVAL_SECS

# --- fixed values ---
# Unicode White_Space code points (what the application's trim removes).
WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Language names of the application and their ISO codes.
LANGUAGE_CODES = {"spanish": "es", "french": "fr", "portuguese": "pt-PT", "german": "de"}
# The opening delimiter of an inline AsciiMath block.
MATH_OPEN = "`math "

_TRIM_RE = rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$"
_EDGE_NON_ALPHA_RE = r"^[^\p{IsAlphabetic}]+|[^\p{IsAlphabetic}]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_trim(c) -> Column:
    """Strip Unicode white space at both ends (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_col(c), _TRIM_RE, "")


def tags_parse(c) -> Column:
    """Comma list -> trimmed, de-duplicated tags in first-seen order.

    ``''`` gives ``['']`` (one empty tag, as the form does); null stays null.
    """
    parts = F.split(_col(c), ",", -1)
    return F.array_distinct(F.transform(parts, unicode_trim))


def xml_tag_extract(c, tag: str) -> Column:
    """Trimmed text between the first ``<tag>`` and the first ``</tag>``.

    Null when either is missing or the closing tag comes first.
    """
    text = _col(c)
    open_tag, close_tag = f"<{tag}>", f"</{tag}>"
    start = F.instr(text, open_tag)
    end = F.instr(text, close_tag)
    body_start = start + F.lit(len(open_tag))
    return F.when(
        (start > 0) & (end > 0) & (end >= body_start),
        unicode_trim(F.substring(text, body_start, end - body_start)),
    )


def response_words(c) -> Column:
    """Lines of the ``<words>`` block, trimmed, empties dropped; no block -> []."""
    block = F.coalesce(xml_tag_extract(c, "words"), F.lit(""))
    lines = F.transform(F.split(block, "\n", -1), unicode_trim)
    return F.filter(lines, lambda w: w != F.lit(""))


def response_sentence(c) -> Column:
    """``struct(text, new_word, translation)`` from the three answer tags."""
    return F.struct(
        xml_tag_extract(c, "new_sentence").alias("text"),
        xml_tag_extract(c, "new_word").alias("new_word"),
        xml_tag_extract(c, "translation").alias("translation"),
    )


def word_normalise(c) -> Column:
    """Strip non-alphabetic characters at both ends, then lower-case.

    Inner characters stay (``l'été``). The caller drops empty results.
    """
    return F.lower(F.regexp_replace(_col(c), _EDGE_NON_ALPHA_RE, ""))


def language_code(c) -> Column:
    """Language name -> ISO code; unknown names give null."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_CODES.items())])
    return F.element_at(mapping, _col(c))


def month(c) -> Column:
    """First day of the month (a date: cheaper as a group key than its text)."""
    return F.trunc(_col(c).cast("date"), "month")


def year_month(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


LAST_MOMENT = "9999-12-31 23:59:59"  # timestamps beyond it cannot be written or compared everywhere


def due_at(last_reviewed, secs) -> Column:
    """``last_reviewed + secs`` seconds (strictly-before-``as_of`` means due).

    Null (never due) when that lies beyond ``LAST_MOMENT``.
    """
    start, secs = _col(last_reviewed), _col(secs)
    left = F.timestamp_diff("SECOND", start, F.lit(LAST_MOMENT).cast("timestamp_ntz"))
    days = F.when(secs <= left, (secs - F.pmod(secs, F.lit(86400))) / 86400)
    step = F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), F.pmod(secs, F.lit(86400)).cast("decimal(18,6)"))
    return F.when(secs <= left, start + step)


def interval_after(base, failed_before, streak) -> Column:
    """Interval after a run of ``streak`` successes: the start value doubled that often.

    ``base`` applies while no failure happened; after a failure the run starts
    from the failed interval. Doubling is exact; null when the result
    does not fit a long (``interval_overflows`` tells that from a null start).
    """
    start, k = _run_start(base, failed_before), _col(streak)
    limit = F.call_function("shiftright", F.lit((1 << 63) - 1), F.least(k, F.lit(62)).cast("int"))
    doubled = F.call_function("shiftleft", start, F.least(k, F.lit(62)).cast("int"))
    return F.when((k <= 62) & (start <= limit), doubled).when(start == 0, start)


def interval_overflows(base, failed_before, streak) -> Column:
    return _run_start(base, failed_before).isNotNull() & interval_after(base, failed_before, streak).isNull()


def _run_start(base, failed_before) -> Column:
    return F.when(_col(failed_before), F.lit(FAIL_INTERVAL_SECS).cast("long")).otherwise(_col(base).cast("long"))


# --- rich text segmentation -------------------------------------------------
# One match = a raw run that cannot start an opener, then optionally
# "`math " + body + closing backtick. A partial opener is consumed together with
# the first character that breaks it, exactly like the character-level reader.
_RUN = (
    r"(?:[^`]++|`(?:[^m]|\z|m(?:[^a]|\z|a(?:[^t]|\z|t(?:[^h]|\z|h(?:[^ ]|\z))))))*+"
)
RICH_TEXT_PATTERN = rf"({_RUN})(?:(`math )([^`]*+)(`?))?"


def rich_text_blocks(c) -> Column:
    """Split text into ``array<struct<kind, text>>`` of ``raw`` and ``math`` blocks.

    Rules: an opener emits the raw text before it even if empty; a closing
    backtick emits the math block even if empty; at the end only a non-empty
    remainder is emitted (as math when unclosed).
    """
    text = _col(c)
    pat = F.lit(RICH_TEXT_PATTERN)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    raws = F.regexp_extract_all(text, pat, F.lit(1))

    def blocks(z):
        raw = z["r"]
        rest = F.substring(z["w"], F.length(raw) + 1, 1 << 30)
        opened = F.startswith(rest, F.lit(MATH_OPEN))
        tail = F.substring(rest, len(MATH_OPEN) + 1, 1 << 30)
        closed = F.endswith(tail, F.lit("`"))
        body = F.when(closed, F.substring(tail, F.lit(1), F.length(tail) - 1)).otherwise(tail)
        raw_block = F.struct(F.lit("raw").alias("kind"), raw.alias("text"), (opened | (raw != "")).alias("keep"))
        math_block = F.struct(F.lit("math").alias("kind"), body.alias("text"),
                              (opened & (closed | (body != ""))).alias("keep"))
        return F.array(raw_block, math_block)

    zipped = F.arrays_zip(whole.alias("w"), raws.alias("r"))
    flat = F.flatten(F.transform(zipped, blocks))
    kept = F.filter(flat, lambda b: b["keep"])
    return F.transform(kept, lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text")))
