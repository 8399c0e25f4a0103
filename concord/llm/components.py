"""Connected components of an edge table, on Spark alone: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return tied.unionByName(own).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v) edges -> (node, root) of every node but the roots, root the least of its component.

    Each round is written to the shared folder and replaces the last one; rounds
    stop when one changes nothing.
    """
    now = stored(_small_star(_large_star(edges.select("u", "v").where("u <> v"))), f"{folder}/round-0")
    last, k = _digest(now), 0
    while last[0]:
        k += 1
        now = stored(_small_star(_large_star(now)), f"{folder}/round-{k}")
        drop_scratch(f"{folder}/round-{k - 1}")
        if (this := _digest(now)) == last:
            break
        last = this
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
