"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _towards_least(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour (or itself)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_side(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the least of them. Links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs to (node, component): the smallest node that each linked node reaches.

    Nodes without a link to another node don't appear. Links with a null, loops and repeated links change nothing. Every
    round is written to the shared folder. The rounds end when a round changes no link.
    """
    now = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (seen["n"], seen["h"])
        now = common.materialize(_smaller_side(_towards_least(now)), "links")
