"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.session import cut, discard


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in a link.

    ``component`` is the smallest node reachable.  Each round hangs every
    neighbour of a node on the smallest node that this node knows (large star),
    then the same among smaller neighbours (small star); the edge set shrinks
    to stars around the smallest nodes in a logarithmic number of rounds.
    Minima are pre-aggregated, so a hub costs one row per task, and the joins
    are plain equi-joins that adaptive execution may split.  Links with a null
    end, and loops, are ignored.  An empty table gives an empty result.
    """
    u, v = F.greatest(a, b).cast("long"), F.least(a, b).cast("long")
    ends = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = cut(links.where(ends).select(u.alias("u"), v.alias("v")).distinct(), "links")
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = cut(large.distinct(), "large-star")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        own = least.select("u", F.col("m").alias("v"))
        edges = cut(small.unionByName(own).distinct(), "small-star")
        discard(large)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
