"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise


def _towards_minimum(edges: DataFrame) -> DataFrame:
    """Every node of ``edges`` with the smallest node next to it, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.filter("v > u").join(_towards_minimum(both), "u")
    return joined.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = _towards_minimum(down)
    joined = down.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return joined.union(lows.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of the links; ``root`` is the smallest node of its component.

    Each round lets every node point at the smallest node it knows of, first for its larger and then
    for its smaller neighbours, and writes the result, until nothing changes. Rounds grow with the
    logarithm of the component sizes. Minima are formed before the shuffle, so a node with very many
    links isn't gathered anywhere. No links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "components")
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
