import datetime as dt

from pyspark.sql import functions as F

from recall.operators import cards as co
from recall.operators.maintenance import cards_add, cards_update
from recall.schema import CARD, CARD_TAG

T0 = dt.datetime(2024, 1, 1)


def _cards(spark, rows):
    return spark.createDataFrame(rows, CARD)


def _card(i, secs=43200, when=T0, q=None):
    return (i, q or f"question{i}", f"answer{i}", None, None, None, when, secs, None)


def test_untagged_cards_vanish_and_empty_tag_stays(spark):
    cards = _cards(spark, [_card(1), _card(2), _card(3)])
    tags = spark.createDataFrame([(1, "x"), (3, "")], CARD_TAG)
    got = {r.id: r.tags for r in co.cards_all(cards, tags).collect()}
    assert got == {1: ["x"], 3: [""]}


def test_filter_by_tag_truncates_tag_list(spark):
    cards = _cards(spark, [_card(1)])
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (1, "a,b")], CARD_TAG)
    assert co.cards_by_tag(cards, tags, "y").collect()[0].tags == ["y"]
    assert co.cards_all(cards, tags).collect()[0].tags == ["a,b", "x", "y"]  # a comma survives


def test_due_is_strict(spark):
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    cards = _cards(spark, [_card(1, 43200), _card(2, 43199), _card(3, None), (4, "q", "a", None, None, None, None,
                                                                                10, None)])
    tags = spark.createDataFrame([(i, "t") for i in range(1, 5)], CARD_TAG)
    assert [r.id for r in co.cards_due(cards, tags, as_of).collect()] == [2]


def test_card_by_id_missing_or_untagged(spark):
    cards = _cards(spark, [_card(1), _card(2)])
    tags = spark.createDataFrame([(1, "x")], CARD_TAG)
    assert co.card_by_id(cards, tags, 2).count() == 0
    assert co.card_by_id(cards, tags, 9).count() == 0
    assert co.card_by_id(cards, tags, 1).count() == 1


def test_update_with_unchanged_tags_keeps_them(spark):
    """Update a card with itself: its tags are still ['tag1']."""
    cards = _cards(spark, [_card(1, q="question1")])
    tags = spark.createDataFrame([(1, "tag1")], CARD_TAG)
    edits = cards.select("id", "question", "answer", "examples", "source", "img", "question_img",
                         F.array(F.lit("tag1")).alias("tags"))
    new_cards, new_tags = cards_update(cards, tags, edits)
    got = co.card_by_id(new_cards, new_tags, 1).collect()[0]
    assert got.tags == ["tag1"] and got.question == "question1"


def test_update_keeps_schedule_and_writes_nulls(spark):
    cards = _cards(spark, [(1, "q", "a", "ex", "src", "img", T0, 99, "qi"), _card(2)])
    tags = spark.createDataFrame([(1, "old"), (2, "keep")], CARD_TAG)
    edits = spark.createDataFrame([(1, "q2", "a2", None, "s2", None, None, ["n1", "n2", "n1"]),
                                   (7, "ghost", "a", None, None, None, None, ["z"])],
                                  "id long, question string, answer string, examples string, source string, "
                                  "img string, question_img string, tags array<string>")
    new_cards, new_tags = cards_update(cards, tags, edits)
    c = {r.id: r for r in new_cards.collect()}
    assert (c[1].question, c[1].examples, c[1].review_after_secs, c[1].last_reviewed) == ("q2", None, 99, T0)
    assert 7 not in c
    assert sorted((r.card_id, r.tag) for r in new_tags.collect()) == [(1, "n1"), (1, "n2"), (2, "keep")]


def test_cards_add_assigns_consecutive_ids(spark):
    cards = _cards(spark, [_card(5), _card(9)])
    drafts = spark.createDataFrame(
        [(k, f"q{k}", "a", "", None, None, T0, 43200, None, ["t", "u"]) for k in [30, 10, 20, 40, 50]],
        "item_id long, question string, answer string, examples string, source string, img string, "
        "last_reviewed timestamp_ntz, review_after_secs long, question_img string, tags array<string>")
    new_cards, new_tags = cards_add(cards, drafts, ["item_id"])
    got = sorted((r.item_id, r.id) for r in new_cards.collect())
    assert got == [(10, 10), (20, 11), (30, 12), (40, 13), (50, 14)]
    assert new_tags.count() == 10


def test_quarantine_status(spark):
    cards = _cards(spark, [_card(1)])
    reviews = spark.createDataFrame([(1, T0, True), (2, T0, False)], "card_id long, review_date timestamp_ntz, "
                                                                     "remembered boolean")
    got = {r.card_id: r.status for r in co.reviews_quarantine(reviews, cards).collect()}
    assert got == {1: "accepted", 2: "quarantined"}


def test_card_listing_and_media(spark):
    cards = _cards(spark, [(1, "q", "a", None, None, "pic.png", dt.datetime(2024, 5, 6, 7, 8, 9), 1, None)])
    tags = spark.createDataFrame([(1, "b"), (1, "a")], CARD_TAG)
    row = co.card_listing(co.cards_all(cards, tags)).collect()[0]
    assert (row.tags, row.last_reviewed) == ("a, b", "2024-05-06 07:08")
    m = co.card_media_links(cards).collect()[0]
    assert (m.img_link, m.question_img_link) == ("/media/pic.png", None)
