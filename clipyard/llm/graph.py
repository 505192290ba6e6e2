"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipyard.llm.common import scratch


def _least():
    """The least neighbour of the row's u."""
    return F.min("v").over(Window.partitionBy("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """May hold an edge more than once, in no more rows than edges has."""
    both = edges.union(edges.select("v", "u"))
    least = both.select("u", "v", F.least(_least(), F.col("u")).alias("m"))
    return least.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.select("u", "v", _least().alias("m"))
    # The edge to the least neighbour stays, and links the node itself; the others link their ends.
    return least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24)).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of links (u, v) but the roots themselves. Each round is written to the shared folder; links never reach the driver."""
    edges = scratch(links.select("u", "v").where("u <> v").distinct(), "links")
    mark = None
    while (new := _mark(edges)) != mark:
        mark = new
        if not mark[0]:
            break
        edges = scratch(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
