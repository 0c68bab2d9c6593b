"""Card files: TOML documents in per-tag folders.

Reading: every ``*.toml`` file under a root (recursively) is one record
(``wholetext``); its tag is the name of the folder holding it (``unknown`` at
the root). A file holds either one card as top-level keys, or many cards as an
array of ``[[cards]]`` tables. TOML is parsed in Arrow batches with the
standard library; an unparsable file yields one row with ``error`` set
instead of failing the job.

Writing: cards are rendered to TOML text with JVM expressions and written with
the text writer, one folder per tag, many cards per file (bounded by
``max_records_per_file``). Writing never happens in place.
"""

from __future__ import annotations

import datetime as dt
import sys
import tomllib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall.schema import CARD

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the parser runs in Python workers

UNKNOWN_TAG = "unknown"  # fixed value: tag of a file without a parent folder

LOADED = T.StructType([T.StructField(f.name, f.dataType, True) for f in CARD.fields] + [
                       T.StructField("tag", T.StringType()),
                       T.StructField("path", T.StringType()),
                       T.StructField("error", T.StringType())])
_REQUIRED = ["id", "question", "answer", "last_reviewed", "review_after_secs", "tags"]  # fields a card file must have
_STRINGS = ["question", "answer", "examples", "source", "img", "question_img"]


def _to_ts(v):
    if v is None:
        return None
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    raise ValueError(f"not a timestamp: {v!r}")


def _card_row(card: dict) -> dict:
    missing = [k for k in _REQUIRED if card.get(k) is None]
    if missing:
        raise ValueError(f"missing field: {', '.join(missing)}")
    row = {"id": int(card["id"]), "review_after_secs": int(card["review_after_secs"]),
           "last_reviewed": _to_ts(card.get("last_reviewed"))}
    for k in _STRINGS:
        v = card.get(k)
        row[k] = None if v is None else str(v)
    return row


def _parse(batches):
    cols = [f.name for f in LOADED.fields]
    for pdf in batches:
        for text, path, tag in zip(pdf["value"], pdf["path"], pdf["tag"]):
            # One frame per file: a batch holds many whole files of many cards each.
            try:
                doc = tomllib.loads(text)
                cards = doc["cards"] if isinstance(doc.get("cards"), list) else [doc]
                rows = [_card_row(c) | {"tag": tag, "path": path, "error": None} for c in cards]
            except (ValueError, TypeError, AttributeError) as ex:  # bad file -> quarantine row
                rows = [{"tag": tag, "path": path, "error": f"{type(ex).__name__}: {ex}"}]
            frame = pd.DataFrame(rows, columns=cols).astype(object)
            yield frame.where(frame.notna(), None)


HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder Spark writes for an empty or null key


def _folder_tag(path):
    """Tag of a file from its folder's name.

    File paths are URI-encoded once; a folder that Spark wrote is ``tag=<escaped value>`` below that,
    any other folder's name is the tag itself.
    """
    def decoded(c):
        return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))

    parts = F.split(path, "/")
    folder = decoded(F.element_at(parts, -2))
    value = F.substring(folder, len("tag=") + 1, 1 << 30)
    ours = F.when(value == HIVE_NULL, F.lit("")).otherwise(decoded(value))
    tag = F.when(F.startswith(folder, F.lit("tag=")), ours).otherwise(folder)
    return F.when(F.size(parts) > 1, tag).otherwise(F.lit(UNKNOWN_TAG))


def load_card_files(spark: SparkSession, root: str, glob: str = "*.toml") -> DataFrame:
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    files = raw.select("value", F.col("_metadata.file_path").alias("path"))
    files = files.withColumn("tag", _folder_tag(F.col("path")))
    return files.mapInPandas(_parse, LOADED)


def _toml_string(c):
    # A JSON string literal is a valid TOML basic string once DEL is escaped too.
    lit = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.when(c.isNotNull(), F.regexp_replace(lit, "\u007f", "\\\\u007f"))


def card_toml(tag_col: str = "tag") -> F.Column:
    """One ``[[cards]]`` table per row (null fields are left out)."""
    def line(key, value):
        return F.concat(F.lit(f"{key} = "), value)
    ts = F.date_format("last_reviewed", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat_ws(
        "\n", F.lit("[[cards]]"),
        line("id", F.col("id").cast("string")),
        *[line(k, _toml_string(F.col(k))) for k in _STRINGS],
        line("last_reviewed", _toml_string(ts)),
        line("review_after_secs", F.col("review_after_secs").cast("string")),
        line("tags", F.concat(F.lit("["), _toml_string(F.coalesce(F.col(tag_col), F.lit(""))), F.lit("]"))),
    )


NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # the default format stops at milliseconds


def _by_tag(rows: DataFrame, tag_col: str) -> DataFrame:
    """Rows of a tag in few tasks, so folders get few files; a tag with many rows is split over tasks."""
    return rows.hint("rebalance", tag_col)


def write_card_toml(cards: DataFrame, root: str, tag_col: str = "tag", max_records_per_file: int = 10_000) -> None:
    """TOML text files, one folder per tag."""
    (_by_tag(cards.select(card_toml(tag_col).alias("value"), F.col(tag_col).alias("tag")), "tag")
     .write.mode("errorifexists").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("tag").text(root))


def write_card_files(cards: DataFrame, tags: DataFrame, root: str, max_records_per_file: int = 100_000) -> None:
    """One record per (card, tag) in that tag's folder, as JSON lines."""
    rows = cards.join(tags.withColumnRenamed("card_id", "id"), "id", "inner")
    # An empty tag cannot name a folder (it would read back as null); map it back on read.
    (_by_tag(rows, "tag").write.mode("errorifexists").option("maxRecordsPerFile", max_records_per_file)
     .option("timestampNTZFormat", NTZ_FORMAT).partitionBy("tag").json(root))


def read_card_files(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType([*CARD.fields, T.StructField("tag", T.StringType())])
    df = spark.read.schema(schema).option("timestampNTZFormat", NTZ_FORMAT).json(root)
    return df.withColumn("tag", F.coalesce(F.col("tag"), F.lit("")))
