"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.storage import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Nodes are longs. Self loops and repeated edges are allowed; rows with a null end are ignored; no edges
    give no rows. The number of rounds grows with the logarithm of the longest path. Every round is written
    to the shared folder, and the minimum of a node's neighbours is pre-aggregated before it is shuffled.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = materialize(edges.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    heads = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(heads)
