"""Sets of keys as bitmaps: rows without a partner are told apart before any shuffle.

A set is a table of blocks, each 32,768 bits in 4 KB. Whole-number keys that lie densely (card ids are given in sequence)
have a bit each: the set is exact and takes the place of the join. Other keys, and numbers spread over too
many blocks, are hashed to two bits of one block: such a set holds all its keys and, by chance, a few others, so the rows it lets
through are still joined. The number of blocks is counted before they are broadcast; beyond ``max_blocks``
(32 MB: up to 268 million dense ids, 33 million hashed keys) there is no set, and callers join as they would without.

A null key is in no set. Repeated keys count once. The set of no keys has no blocks and holds nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from recall.operators.cards import accepted, mark_known
from recall.sources.tables import materialize

BLOCK_BITS = 32_768  # what bitmap_construct_agg gathers in one value
MAX_BLOCKS = 8192
BITS_A_KEY = 8


class IdSet(NamedTuple):
    blocks: DataFrame  # (_block, _bitmap)
    n_hashed: int  # blocks that keys are hashed over; 0 where each key has its own bit

    @property
    def exact(self) -> bool:
        return self.n_hashed == 0


def _dense_block(key: Column) -> Column:
    return F.shiftright(key.cast("long"), 15)


def _places(key: Column, n_hashed: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bits there."""
    low = F.lit(BLOCK_BITS - 1).cast("long")
    if n_hashed == 0:
        return _dense_block(key), [key.cast("long").bitwiseAND(low)]
    # A null is no key; the hash function alone would give it a place.
    h = F.when(key.isNotNull(), F.xxhash64(key))
    return F.pmod(h, F.lit(n_hashed).cast("long")), [F.shiftright(h, by).bitwiseAND(low) for by in (16, 40)]


def _blocks(keys: DataFrame, on: str, n_hashed: int) -> DataFrame:
    block, bits = _places(F.col(on), n_hashed)
    rows = keys.where(F.col(on).isNotNull()).select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit"))
    return rows.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def id_set(keys: DataFrame, on: str, max_blocks: int = MAX_BLOCKS) -> IdSet | None:
    """The set of the values of ``on``, or None where it would take more than ``max_blocks`` blocks."""
    key = F.col(on)
    dense = isinstance(keys.schema[on].dataType, IntegralType)
    n, n_dense = keys.agg(F.count(key), F.count_distinct(_dense_block(key)) if dense else F.lit(None).cast("long")).first()
    if dense and n_dense <= max_blocks:
        return IdSet(_blocks(keys, on, 0), 0)
    n_hashed = max(1, -(-n * BITS_A_KEY // BLOCK_BITS))
    return IdSet(_blocks(keys, on, n_hashed), n_hashed) if n_hashed <= max_blocks else None


def with_membership(rows: DataFrame, on: str, ids: IdSet, name: str = "_in") -> DataFrame:
    """``rows`` with a boolean: false where ``on`` is surely not in the set; true is certain for an exact set only.

    The broadcast is bounded by the ``max_blocks`` the set was made with. Rows are not moved.
    """
    block, bits = _places(F.col(on), ids.n_hashed)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1)) == 1

    found = is_set(bits[0])
    for bit in bits[1:]:
        found = found & is_set(bit)
    joined = rows.withColumn("_block", block).join(F.broadcast(ids.blocks), "_block", "left")
    return joined.select(*rows.columns, F.coalesce(found, F.lit(False)).alias(name))


def merged(a: IdSet, b: IdSet) -> IdSet:
    """The union of two exact sets, such as that of a store and that of the cards just added to it."""
    if not (a.exact and b.exact):
        raise ValueError("only exact sets can be merged: hashed ones have blocks for their own number of keys")
    return IdSet(a.blocks.unionByName(b.blocks).groupBy("_block").agg(F.bitmap_or_agg("_bitmap").alias("_bitmap")), 0)


def accepted_by_set(rows: DataFrame, keys: DataFrame, on: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``accepted``: the rows whose ``on`` is among the keys. An exact set filters them in place; a hashed one
    leaves out most others before the join."""
    ids = id_set(keys, on, max_blocks)
    if ids is None:
        return accepted(rows, keys, on)
    kept = with_membership(rows, on, ids).where("_in").drop("_in")
    return kept if ids.exact else accepted(kept, keys, on)


def mark_known_by_set(rows: DataFrame, keys: DataFrame, on: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``mark_known``: adds ``status``. With an exact set no row is shuffled; with a hashed one only those it lets through are."""
    ids = id_set(keys, on, max_blocks)
    if ids is None:
        return mark_known(rows, keys, on)
    marked = with_membership(rows, on, ids)
    if ids.exact:
        return marked.withColumn("status", F.when(F.col("_in"), F.lit("accepted")).otherwise(F.lit("quarantined"))).drop("_in")
    surely_not = marked.where(~F.col("_in")).drop("_in").withColumn("status", F.lit("quarantined"))
    return mark_known(marked.where("_in").drop("_in"), keys, on).select(*surely_not.columns).unionByName(surely_not)


def fetched(rows: DataFrame, wanted: DataFrame, on: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` joined with ``wanted`` on the key: wide rows that nobody wants are left out before the join moves them.

    ``wanted`` is written first, as the set and the join both read it.
    """
    wanted = materialize(wanted, "wanted")
    ids = id_set(wanted, on, max_blocks)
    if ids is not None:
        rows = with_membership(rows, on, ids).where("_in").drop("_in")
    return rows.join(wanted, on)
