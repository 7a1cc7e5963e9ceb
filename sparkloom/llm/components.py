"""Connected components of a graph of 64-bit nodes, distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b) that is not its component's smallest node.

    Nulls and loops link nothing; repeated links count once; no links give no rows.
    Every step is a minimum per node (combined before the shuffle) joined back to
    the links, so a node with very many links is split by the skew join. The table
    of links is written to shared storage after each step; nothing is collected
    but a count. The number of steps is logarithmic.
    """
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    pairs = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = written(pairs, "links")
    while not _stars(now):
        star, at = written(_small_star(_large_star(now)), "links")
        removed(spark, path)
        now, path = star, at
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether each u has one v, which is no u: then v, being smaller, is the smallest node of its component."""
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("to")).unionAll(e.select("v", F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count("to").alias("links"), F.min("to").alias("low"), F.max("to").alias("high"))
    return seen.agg(F.count_if(F.expr("links > 0 and (n > links or low < high)"))).first()[0] == 0


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
