"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROUNDS = 60


def components(links: DataFrame, prune_key: str = "components", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the smallest node that it reaches.

    Each round points every larger neighbour at the smallest one of its star, first over both
    directions and then over smaller neighbours only; the links become stars rooted at the minimum.
    Minima are combined in the input tasks before any shuffle. A round's tasks follow from the number of its
    links, those of the first step from ``rows``, the number of ``links`` where that is known.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), prune_key, rows)
    shape = shape_of(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        smallest = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(smallest, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        mins = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(mins, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(mins.select("hi", F.col("m").alias("lo"))).distinct()
        # both directions of each link meet
        edges = stage(small, prune_key, 2 * shape[0])
        found = shape_of(edges)
        if found == shape:
            break
        shape = found
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def shape_of(edges: DataFrame) -> tuple:
    """The number of links and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
