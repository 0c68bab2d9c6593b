"""Connected components of a large graph of long ids, by contraction to stars.

Each round replaces the edges by stars around smaller ids (first around each node's
smallest neighbour for its larger neighbours, then for its smaller ones); the
number of rounds grows with the logarithm of the longest path. A round is two
aggregates with partial sums and two joins. The joins' sides are written tables, so adaptive
execution can split a hot centre, and a lost executor repeats one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import written

MOST_ROUNDS = 60


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on ``(a, b)``, a > b."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    # Larger neighbours of each node go to the node's smallest neighbour.
    low = written(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low")), "lows")
    large = (both.filter("other > node").join(low, "node")
             .select(F.col("other").alias("a"), F.col("low").alias("b")).filter("a > b"))
    # Each node and its smaller neighbours go to the smallest of them.
    large = written(large.distinct(), "large-stars")
    low = written(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
    small = large.join(low, "a")
    return small.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").union(
        low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, root)`` for every node of the links ``(a, b)`` that is not itself the smallest of its component."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "stars")
    seen = None
    for _ in range(MOST_ROUNDS):
        count, mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if (count, mark) == seen:
            break
        seen = (count, mark)
        if count == 0:
            break
        now = written(star_round(now), "stars")
    else:
        raise RuntimeError("components did not settle")
    return now.select("a", F.col("b").alias("root"))
