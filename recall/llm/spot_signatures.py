"""Document fingerprints by spot signatures, native expressions only.

A text is known by the places where common words stand: at each anchor (a word that is common
in its language) a signature is the anchor and the next content words, the words that are no
anchors. A fingerprint is the set of a text's signatures, as sorted 32-bit hashes. An edit changes only
the signatures around it, and boilerplate has few anchors, so few signatures.

Anchors are the words most documents of a language have, counted over all documents; which
language a text is said to have plays no part in its own fingerprint, so equal texts
have equal ones. In a stretch without anchors, each run of ``CHAIN + 1`` content words is a signature too; a text
with fewer than ``FEW`` signatures has its words as further ones.

Fingerprints are compared by length first: lengths fall into partitions in the ratio ``1 / least``, and two sets
more than one partition apart cannot be alike by ``least``, so their likeness is 0 without a look at them.
All others get their Jaccard similarity: common signatures over all signatures of the two.

``with_next`` puts the next document's columns beside each document's. The order's splitters are
the first keys of a range partitioning of the keys alone; each row finds its range by binary search
among them, the first row of each range is sent to the range before as well, and so texts are shuffled once
and no task holds more than a range.

Defined cases: a null or empty text, or one without words, has one signature, the hash of the whole text; a null
id comes after all others, equal ids follow in the order of their files' rows; a single document is its own next; an empty table
gives an empty result; of the rows' columns only ``doc_id``, ``text`` and ``lang`` are read. Very long texts are one array of words while they
are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.rows import text_or_empty

WORD = r"[\p{L}\p{M}\p{N}]+"
CHAIN = 3             # content words of a signature, at most
SKIPPED = 8           # further anchors in a row that a chain passes over
FEW = 16
SHARE = 0.25          # of a language's documents have an anchor
ANCHORS = 50          # of a language, at most
LANGUAGES = 64        # with the most documents; texts of others use these languages' anchors, or every word
LEAST = 0.1
MARK = "\x01"
ROWS_PER_RANGE = 50_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def anchor_words(docs: DataFrame) -> list[str]:
    """The most common words of the largest languages, at most ``LANGUAGES * ANCHORS``.

    A word in a quarter of the documents is one of at most four times as many as a document has words, so few are ranked.
    """
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), text_or_empty().alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(LANGUAGES)
    seen = rows.select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("found"))
    common = seen.join(F.broadcast(sizes), "lang").filter(F.col("found") >= SHARE * F.col("docs"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("found"), "word"))
    return sorted({r["word"] for r in common.withColumn("place", place).filter(F.col("place") <= ANCHORS).select("word").collect()})


def with_signatures(rows: DataFrame, text: str, name: str, anchors: list[str]) -> DataFrame:
    """``rows`` with the sorted set of the text's signatures (never empty) as ``name``.

    The steps are columns of their own, so that none is computed again wherever the next one uses it.
    """
    is_anchor = lambda w: w.isin(anchors) if anchors else F.lit(False)
    mark = lambda w: F.when(is_anchor(w), F.concat(F.lit(MARK), w)).otherwise(w)
    # From each word on: an anchor and up to CHAIN content words, with the anchors between them; or CHAIN + 1 content words.
    between = rf"(?: {MARK}[^ ]++){{0,{SKIPPED}}}+ [^{MARK} ][^ ]*+"
    spot = rf"(?=({MARK}[^ ]++(?:{between}){{1,{CHAIN}}}+|[^{MARK} ][^ ]*+(?: [^{MARK} ][^ ]*+){{{CHAIN}}}|))[^ ]++ ?"
    passed = f" {MARK}"
    without = lambda c: F.when(F.contains(c, F.lit(passed)), F.regexp_replace(c, rf"{passed}[^ ]++", "")).otherwise(c)
    rows = rows.withColumn("_words", words(F.col(text)))
    rows = rows.withColumn("_marked", F.array_join(F.transform("_words", mark), " "))
    found = F.array_remove(F.array_distinct(F.regexp_extract_all("_marked", F.lit(spot), F.lit(1))), "")
    rows = rows.withColumn("_chains", F.array_distinct(F.transform(found, without)))
    chains = (F.when(F.size("_words") == 0, F.array(F.col(text)))  # a text without words has one, itself
              .when(F.size("_chains") < FEW, F.concat("_chains", "_words")).otherwise(F.col("_chains")))
    hashed = F.transform(chains, lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.withColumn(name, F.sort_array(F.array_distinct(hashed))).drop("_words", "_marked", "_chains")


def as_text(found: Column) -> Column:
    """A fingerprint as hex digits, eight for each signature."""
    return F.lower(F.array_join(F.transform(found, lambda s: F.lpad(F.hex(s), 8, "0")), ""))


def length_part(found: Column, least: float) -> Column:
    """The partition of a set's length: partition k begins at ``least ** -k`` signatures."""
    return F.floor(F.log(F.size(found).cast("double")) / math.log(1 / least) + 1e-9).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two sets of signatures; 0 if their lengths alone put it under ``least``."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.abs(length_part(a, least) - length_part(b, least)) > 1, F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common))


def range_of(key: Column, firsts: Column, n: int) -> Column:
    """Number of the range, counted from 0, whose first key is the last one not above ``key``."""
    steps = [1 << b for b in range(max(n - 1, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: at + F.when(
        (at + step < n) & (F.get(firsts, at + step) <= key), step).otherwise(0))


def with_next(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row with the next ``key`` (of the first one, for the last).

    ``keys`` are the keys alone, whose ranges give the splitters: as many as shuffle partitions, more if a range would
    have over ``ROWS_PER_RANGE`` rows.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // ROWS_PER_RANGE))
    ranged = keys.select("key.*").repartitionByRange(n, *[F.col(f) for f in keys.schema["key"].dataType.names])
    found = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct("*")).alias("first")).select("first").orderBy("first").collect()
    kind = keys.schema["key"].dataType
    # The splitters travel as one literal array.
    firsts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["first"], kind.fields)]) for r in found])
    ranges = max(1, len(found))
    if not found:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).limit(0)
    own = rows.withColumn("_range", range_of(F.col("key"), firsts, ranges))
    before = F.pmod(F.col("_range") - 1, F.lit(ranges))
    first = F.get(firsts, F.col("_range")) == F.col("key")
    place = lambda at, is_next: F.struct(at.cast("int").alias("range"), F.lit(is_next).alias("is_next"))
    sent = own.withColumn("_place", F.explode(F.when(first, F.array(place(F.col("_range"), False), place(before, True))).otherwise(
        F.array(place(F.col("_range"), False)))))
    sent = sent.withColumn("_range", F.col("_place.range")).repartition(n, "_range")
    order = Window.partitionBy("_range").orderBy("_place.is_next", "key")
    led = sent.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.filter(~F.col("_place.is_next")).drop("_range", "_place")


def fingerprints(source: DataFrame, anchors: list[str], least: float = LEAST) -> DataFrame:
    """One row for each of ``located(docs)``: its fingerprint, that of its edited text, and both likenesses.

    The edited text has the last quarter of its characters replaced by as many (or all) from the beginning of the next document.
    """
    doc_id = F.col("doc.doc_id").cast("long")
    key = F.struct(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    keys = source.select(key.alias("key"))
    rows = source.select(key.alias("key"), F.coalesce("doc.text", F.lit("")).alias("text"))
    rows = with_signatures(rows, "text", "sigs", anchors)
    led = with_next(rows, keys, ["text", "sigs"]).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = led.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars AS int) - cast(floor(n_chars / 4) AS int))"),
                                               F.left(F.col("next_text"), cut)))
    edited = with_signatures(edited, "edited", "edited_sigs", anchors)
    return edited.select(
        F.when(~F.col("key.no_id"), F.col("key.id")).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs"), least).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs"), least).alias("near_next"), F.size("sigs").cast("long").alias("n_signatures"))
