"""Connected components by alternating large-star and small-star rounds; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, materialise


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """For every node the least of itself and its neighbours in ``pairs`` (u, v)."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """node, component: the smallest node reachable, for every node on an edge of ``edges`` (u, v: long, undirected).

    Loops and repeated edges are harmless, edges with a null end are ignored, no edges give no rows.  Each round
    groups with map-side partial minima and joins on the node, so a hub is split by adaptive skew handling; each
    round's edges are written to the shared folder, and those of the round before are removed.  The result is written, too
    (as a table of ``keep``, if given).
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = _least_neighbour(down)
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = Scratch(edges.sparkSession)
        edges = following.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        scratch.clear()
        scratch = following
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    named = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    named = named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    named = keep.keep(named, "components") if keep else materialise(named, "components")
    scratch.clear()
    return named
