"""Card file source and sink as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall.plans.oracle import with_ctes
from recall.plans.queries import query
from recall.session import shared_dir
from recall.sources import card_files as cf
from recall.sources import fixtures as fx


# Characters that folder names escape, and the empty tag, by the card's id.
ODD_TAGS = {1: "a b", 2: "x,y", 3: "k=v", 4: "50%", 5: "c++", 6: "", 7: "tag=é/ü"}
ODD_TAGS_SQL = f"""
    , odd_tags AS (SELECT card_id, CASE card_id % 50 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in ODD_TAGS.items())}
                          ELSE tag END AS tag FROM flashcard_tags)"""


def odd_tags(rows, key):
    tag = F.col("tag")
    for k, v in ODD_TAGS.items():
        tag = F.when(F.col(key) % 50 == k, F.lit(v)).otherwise(tag)
    return rows.withColumn("tag", tag)


def precise(cards):
    """Cards with review times down to the microsecond."""
    micros = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 1237 % 1000000 / F.lit(1000000)).cast("decimal(18,6)"))
    return cards.withColumn("last_reviewed", F.col("last_reviewed") + micros)


@query("write_card_files", with_ctes(["cards", "flashcard_tags"], f"""{ODD_TAGS_SQL}
    SELECT c.* EXCLUDE (last_reviewed), last_reviewed + to_microseconds(c.id * 1237 % 1000000) AS last_reviewed, t.tag
    FROM cards c JOIN odd_tags t ON c.id = t.card_id"""))
def q_write_card_files(spark, sf):
    root = shared_dir(spark, "card_files_json")
    cf.write_card_files(precise(fx.cards(spark, sf)), odd_tags(fx.flashcard_tags(spark, sf), "card_id"), root)
    return cf.read_card_files(spark, root)


@query("load_card_files", with_ctes(["cards"], f"""
    , tagged AS (SELECT id AS card_id, source AS tag FROM cards){ODD_TAGS_SQL.replace('flashcard_tags', 'tagged')}
    SELECT c.* EXCLUDE (last_reviewed), last_reviewed + to_microseconds(c.id * 1237 % 1000000) AS last_reviewed, t.tag,
           CAST(NULL AS VARCHAR) AS error
    FROM cards c JOIN odd_tags t ON c.id = t.card_id"""))
def q_load_card_files(spark, sf):
    root = shared_dir(spark, "card_files_toml")
    cards = precise(fx.cards(spark, sf)).withColumn("tag", F.col("source"))
    cf.write_card_toml(odd_tags(cards, "id"), root)
    loaded = cf.load_card_files(spark, root, glob="*.txt")
    return loaded.drop("path")
