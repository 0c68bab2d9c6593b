"""Key sets: membership, the three ways of a quarantine, and plans that move no row without need."""

import random

import pytest
from pyspark.sql import functions as F

from recall.operators import cards as co
from recall.operators import idsets as ids
from recall.operators import mining as mi
from recall.schema import WORD
from recall.sources import fixtures as fx
from tests.conftest import SF001
from tests.test_plans import _no_broadcast, _plan

EDGES = [None, 0, 1, -1, 63, 64, 32767, 32768, 32769, -32768, -32769, 2**31, 2**63 - 1, -(2**63)]


def _rows(spark, keys, kind="long"):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"card_id {kind}, n long")


def _got(df):
    return sorted(df.collect(), key=str)


def _sample(seed, n=3000):
    r = random.Random(seed)
    dense = [r.randrange(-70_000, 70_000) for _ in range(n)]
    return [k for k in dense if r.random() < 0.5] * 2 + EDGES[::2], dense + EDGES


@pytest.mark.parametrize("max_blocks", [ids.MAX_BLOCKS, 3, 0], ids=["exact", "hashed", "none"])
def test_long_keys_by_set_equal_the_join(spark, max_blocks):
    known, asked = _sample(1)
    keys, rows = _rows(spark, known).select("card_id"), _rows(spark, asked)
    made = ids.id_set(keys, "card_id", max_blocks)
    assert (made is None) == (max_blocks == 0) and (made is None or made.exact == (max_blocks == ids.MAX_BLOCKS))
    assert _got(ids.mark_known_by_set(rows, keys, "card_id", max_blocks)) == _got(co.mark_known(rows, keys, "card_id"))
    assert _got(ids.accepted_by_set(rows, keys, "card_id", max_blocks)) == _got(co.accepted(rows, keys, "card_id"))
    assert _got(ids.fetched(rows, keys.distinct(), "card_id", max_blocks)) == _got(rows.join(keys.distinct(), "card_id"))


def test_exact_membership_of_every_key(spark):
    known, asked = _sample(2)
    got = ids.with_membership(_rows(spark, asked), "card_id", ids.id_set(_rows(spark, known), "card_id")).collect()
    has = set(known) - {None}
    assert len(got) == len(asked) and all(r["_in"] == (r["card_id"] in has) for r in got)


def test_int_and_string_keys(spark):
    ints, asked = _rows(spark, [5, 5, None, -3], "int"), _rows(spark, [5, -3, 4, None], "int")
    assert _got(ids.mark_known_by_set(asked, ints.select("card_id"), "card_id")) == _got(co.mark_known(asked, ints.select("card_id"), "card_id"))
    words = [f"w{i}" for i in range(5000)]
    keys, rows = _rows(spark, words[::2] + ["", None], "string").select("card_id"), _rows(spark, words + ["", None, "é"], "string")
    made = ids.id_set(keys, "card_id")
    assert not made.exact
    marked = ids.with_membership(rows, "card_id", made).collect()
    through = {r["card_id"] for r in marked if r["_in"]}
    assert set(words[::2]) | {""} <= through and None not in through
    assert len(through) < 2501 + 0.15 * 2500  # few others by chance
    assert _got(ids.mark_known_by_set(rows, keys, "card_id")) == _got(co.mark_known(rows, keys, "card_id"))


def test_no_keys_and_no_rows(spark):
    none = _rows(spark, [])
    some = _rows(spark, [1, None])
    assert [r["status"] for r in ids.mark_known_by_set(some, none.select("card_id"), "card_id").collect()] == ["quarantined"] * 2
    assert ids.mark_known_by_set(none, some.select("card_id"), "card_id").collect() == []
    assert ids.accepted_by_set(some, none.select("card_id"), "card_id").collect() == []


def test_merged_sets(spark):
    a, b = _rows(spark, [1, 2, 40_000]), _rows(spark, [2, 3, -7])
    both = ids.merged(ids.id_set(a, "card_id"), ids.id_set(b, "card_id"))
    got = ids.with_membership(_rows(spark, [-7, 1, 2, 3, 4, 40_000]), "card_id", both)
    assert [r["_in"] for r in got.orderBy("card_id").collect()] == [True, True, True, True, False, True]
    with pytest.raises(ValueError):
        ids.merged(ids.id_set(a, "card_id", 1), ids.id_set(b, "card_id"))


def test_quarantine_by_set_moves_no_row(spark):
    cards = fx.cards(spark, SF001).select(F.col("id").alias("card_id"))
    tags = fx.imported_tags(spark, SF001)
    plan = _no_broadcast(spark, lambda: ids.mark_known_by_set(tags, cards, "card_id")).split("+- == Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    # The only rows dealt by a hash are the set's own blocks.
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("_block" in line for line in dealt)


def test_texts_are_filtered_before_they_are_joined(spark):
    docs = fx.documents(spark, SF001)
    known = spark.createDataFrame([("en", w, "", None) for w in ("the", "a")], WORD)
    plain = mi.new_word_sentences(docs, known)
    by_set = mi.new_word_sentences(docs, known, by_id_set=True)
    assert _got(by_set) == _got(plain)
    plan = _no_broadcast(spark, lambda: mi.new_word_sentences(docs, known, by_id_set=True)).split("+- == Initial Plan ==")[0]
    assert "_bitmap" in plan and "SortMergeJoin" in plan
    assert "_bitmap" not in _plan(plain)
