"""Point reads and edits of tables in hash buckets."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recall.operators import cards as co
from recall.operators.maintenance import cards_update, last_edits
from recall.operators.vocab import words_delete, words_update
from recall.schema import CARD, WORD
from recall.sources import fixtures as fx
from recall.sources.bucket_store import CardStore, WordStore
from tests.conftest import SF001

T0 = dt.datetime(2024, 1, 1)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def scans(df):
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "FileScan" in line]


def rows_read(df):
    """Rows that the scans of a finished query gave, from the plan's own metrics."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return total


@pytest.fixture(scope="module")
def card_store(spark):
    store = CardStore(tempfile.mkdtemp(prefix="store-"), buckets=16)
    store.save(fx.cards(spark, SF001), fx.flashcard_tags(spark, SF001))
    return store


def test_a_look_up_reads_one_folder(spark, card_store):
    cards, tags = fx.cards(spark, SF001), fx.flashcard_tags(spark, SF001)
    for card_id in (0, 7, 42, 123, 10**9):
        found = card_store.card_by_id(spark, card_id)
        assert [r.asDict() for r in found.collect()] == [r.asDict() for r in co.card_by_id(cards, tags, card_id).select(*found.columns).collect()]
    for line in scans(card_store.card_by_id(spark, 42)):
        filters = line.split("PartitionFilters: ")[1].split("]")[0]
        assert "bucket" in filters and "pmod" not in filters and "EqualTo" in line
    assert len(scans(card_store.card_by_id(spark, 42))) >= 2


def test_bloom_filters_skip_files_of_a_bucket(spark):
    """Ids 0, 3, 6, ... in files that all span the whole range: only a Bloom filter can rule a file out."""
    cards = spark.createDataFrame([(i * 3, "q", "a", None, None, None, T0, 43200, None) for i in range(4000)], CARD)
    store = CardStore(tempfile.mkdtemp(prefix="store-"), buckets=1)
    for part in range(8):  # each file holds every eighth id
        store.cards.write(cards.where(f"(id div 3) % 8 = {part}").coalesce(1), mode="append")
    assert len(files(store.cards.path)) == 8
    hit, miss = store.cards.rows_of(spark, id=2400), store.cards.rows_of(spark, id=2401)
    assert hit.count() == 1 and miss.count() == 0
    assert rows_read(store.cards.rows_of(spark, id=2400)) <= 1000 and rows_read(store.cards.rows_of(spark, id=2401)) <= 500
    assert rows_read(store.cards.read(spark).where("id > 2400")) > 1000


def test_card_edits_rewrite_only_their_folders(spark):
    cards, tags = fx.cards(spark, SF001), fx.flashcard_tags(spark, SF001)
    store = CardStore(tempfile.mkdtemp(prefix="store-"), buckets=16)
    store.save(cards, tags)
    before = files(store.cards.path), files(store.tags.path)
    edits = fx.card_edits(spark, SF001).where("id IN (20, 40, 100)").unionByName(
        fx.card_edits(spark, SF001).where("id = 20").withColumn("id", F.lit(10**9)))
    store.update(edits, ["edit_no"])
    want_cards, want_tags = cards_update(cards, tags, edits, ["edit_no"])
    got_cards, got_tags = store.cards.read(spark).select(*CARD.names), store.tags.read(spark).select("card_id", "tag")
    assert got_cards.exceptAll(want_cards).isEmpty() and want_cards.exceptAll(got_cards).isEmpty()
    assert got_tags.exceptAll(want_tags).isEmpty() and want_tags.exceptAll(got_tags).isEmpty()
    touched = {f"bucket={f['bucket']}" for f in store.cards.touched(edits)}
    for old, now in zip(before, (files(store.cards.path), files(store.tags.path))):
        assert {p: t for p, t in old.items() if not any(f"/{b}/" in p for b in touched)}.items() <= now.items()
        assert not any(p in now for p in old if any(f"/{b}/" in p for b in touched))


def words(spark):
    rows = [(lang, f"{lang}{i}", None if i % 3 else f"t{i}", T0) for lang in ("es", "fr") for i in range(200)]
    return spark.createDataFrame(rows, WORD)


def test_word_edits_and_deletions_rewrite_only_their_folders(spark):
    store = WordStore(tempfile.mkdtemp(prefix="store-"), buckets=8)
    store.save(words(spark))
    before = files(store.words.path)
    edits = spark.createDataFrame([("es", "es5", "five", 1), ("es", "es5", None, 2), ("es", "nothing", "x", 1), ("xx", "es5", "x", 1)],
                                  "lang string, word string, translation string, n int")
    store.update(edits, ["n"])
    want = words_update(words(spark), edits, ["n"])
    assert store.all(spark).exceptAll(want).isEmpty() and want.exceptAll(store.all(spark)).isEmpty()
    assert [r.translation for r in store.word(spark, "es", "es5").collect()] == [None]
    now = files(store.words.path)
    assert len(before.items() - now.items()) <= 2 and all("lang=es" in p for p, _ in before.items() - now.items())
    keys = words(spark).where("lang = 'fr'").select("lang", "word")  # every word of a language: its folders go
    store.delete(keys.unionByName(edits.select("lang", "word")))
    left = words_delete(want, keys.unionByName(edits.select("lang", "word")))
    assert store.all(spark).exceptAll(left).isEmpty() and left.exceptAll(store.all(spark)).isEmpty()
    assert not any("lang=fr" in p for p in files(store.words.path)) and store.word(spark, "fr", "fr1").isEmpty()
    (line,) = scans(store.word(spark, "es", "es7"))
    filters = line.split("PartitionFilters: ")[1].split("]")[0]
    assert "lang" in filters and "bucket" in filters


def test_an_edit_of_nothing_changes_nothing(spark):
    store = WordStore(tempfile.mkdtemp(prefix="store-"), buckets=4)
    store.save(words(spark))
    before = files(store.words.path)
    store.delete(spark.createDataFrame([], "lang string, word string"))
    store.update(spark.createDataFrame([("xx", "x", "y")], "lang string, word string, translation string"))
    assert files(store.words.path) == before


def test_two_different_edits_of_a_key_need_an_order(spark):
    edits = [("es", "a", "x", ["t"]), ("es", "a", "x", ["t"]), ("es", "b", None, None)]
    schema = "lang string, word string, translation string, tags array<string>"
    assert sorted(map(tuple, last_edits(spark.createDataFrame(edits, schema), ["lang", "word"], None).collect()), key=str) == [
        ("es", "a", "x", ["t"]), ("es", "b", None, None)]
    with pytest.raises(PySparkException, match="different edits of one key"):
        last_edits(spark.createDataFrame([*edits, ("es", "a", "y", ["t"])], schema), ["lang", "word"], None).collect()
