"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchframe.llm.common import discard, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    ends = edges.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("u").agg(F.sum("hangs").alias("h"), F.max("holds").alias("o")).where("h > 1 OR h = 1 AND o = 1").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (smallest node reachable) of every node in ``links`` (a, b).

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the
    smaller ones; the number of links never grows, and stars remain after a logarithmic number
    of rounds.  Every half round is written, so nothing is recomputed; one flag reaches the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    for _ in range(rounds):
        if _are_stars(edges):
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            stars._written = edges._written
            return stars
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # larger neighbours of u hang on its smallest neighbour
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .where("u > v").distinct(), "large-star")
        discard(edges)
        # and u with its smaller neighbours on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(
            low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "small-star")
        discard(large)
    raise RuntimeError("components did not settle")
