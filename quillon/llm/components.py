"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.frames import cut, discard, with_totals


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours above a node move to its least neighbour, then those below.

    The neighbours of a star's centre are split over several tasks.  Below a node
    are only the centres that it was next to.
    """
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    rooted = with_totals(both, ["node"], ["other"], F.least(F.min("other"), F.first("node")).alias("root"))
    large = rooted.filter("other > node").select(F.col("other").alias("high"), F.col("root").alias("low")).filter("high <> low").distinct()
    least = large.groupBy("high").agg(F.min("low").alias("root"))
    joined = large.join(least, "high")
    small = joined.select(F.col("low").alias("high"), F.col("root").alias("low")).union(least.select("high", F.col("root").alias("low")))
    return small.filter("high <> low").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reachable.

    ``links`` has two long columns ``a``, ``b``.  Each round is written to the
    shared folder; rounds end when the edges no longer change, which takes about
    the logarithm of the longest path; a round's table is deleted once the next is
    written.  After `most_rounds` it raises.  Null nodes have no links; links of a
    node with itself, repeated links and no links at all are fine.
    """
    edges = cut(links.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        former, edges = edges, cut(_stars(edges))
        discard(former)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
