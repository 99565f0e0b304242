"""Connected components of a graph of any size, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import forget, written


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for the nodes of edges ``a``, ``b`` (long, never null).

    Alternates large-star and small-star steps; each ends in a table in the shared folder. A hub is reduced to one row
    of its smallest neighbour before it is joined, and the hub's side of that join can be split by adaptive execution.
    Ends when a round changes no edge: about log2 of the longest path.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    size = _state(now)
    while size[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        mid = written(large.distinct(), "large-star")
        near = _nearest(mid)
        small = mid.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "small-star")
        after = _state(new)
        forget(now, mid)
        now = new
        if after == size:
            break
        size = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """A digest of a set of edges: its size and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(2**31 - 1))), F.sum(F.pmod(h, F.lit(2**30 - 35)))).first())
