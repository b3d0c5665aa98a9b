"""Connected components of a graph whose links are rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of links; nodes are longs.

    Large-star and small-star steps in turn until nothing changes: each hangs a node's neighbours
    under its smallest neighbour, so a chain halves and a star is done at once. Minima are combined before they
    are shuffled, and each step is a written table, so lineage stays short.
    """
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "edges")
        discard(edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(found: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """found (node, component) after more links: only what they join, components as single nodes, is worked on."""
    own = found.select("node", "component")
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    for end in ("x", "y"):
        ends = ends.join(own.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")), end, "left").withColumn(end, F.coalesce(f"{end}_component", end)).drop(f"{end}_component")
    joined = components(ends.where("x != y").distinct(), "x", "y")
    joined = materialize(joined, "joined")
    new = joined.select("node", F.col("node").alias("component")).join(own.select("node"), "node", "left_anti")
    final = joined.select(F.col("node").alias("component"), F.col("component").alias("final"))
    return own.union(new).join(final, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
