"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import dropped, landed


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties every node u, and all its smaller neighbours v, to the smallest of these."""
    least = landed(edges.groupBy("u").agg(F.min("v").alias("m")), edges)
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    found = landed(tied.union(least.select("u", F.col("m").alias("v"))).distinct(), edges)
    dropped(edges, least)
    return found


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties all larger neighbours of every node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = landed(both.groupBy("u").agg(F.min("v").alias("m")), edges)
    found = landed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), edges)
    dropped(edges, least)
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every node is tied to one node only, and no node that others are tied to is tied itself."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("holds")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    each = nodes.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("holds").alias("holds"))
    return each.where("tied > 1 OR tied = 1 AND holds = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id it is connected to) of every id in `links` (columns a, b).

    Small and large stars take turns until nothing but stars is left; both keep the components, and the rounds grow with
    the logarithm of the size. Minima are pre-aggregated and stored before they are joined, so the join reads plain
    tables, which Spark can broadcast if small and split by rows if one node has very many links. The driver learns only
    whether to go on.
    """
    edges = landed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = _small_star(edges)
    while not _stars(edges):
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
