"""Connected components over tables of links, by alternating stars.

Each round hangs every node's larger neighbours under its smallest one, then the smaller ones, until each
component is one star. Links stay in tables; only one count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stage


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``links`` of ``a`` and ``b``, integers -> ``node``, ``component`` (smallest node reachable) of every linked node.

    ``known`` is the result of an earlier call, to which ``links`` are added.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        edges = edges.union(known.select("node", "component"))
    edges = stage(edges.filter("u <> v").distinct())
    while not _stars(edges):
        edges = stage(_star(_star(edges, larger=True), larger=False).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct().toDF("node", "component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` only and no ``v`` is a ``u``; the smaller end of a link is ``v``, so each star then hangs under its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
    at = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return at.filter("low + top > 1").count() == 0


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(low, "u")
    if larger:
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    near = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
