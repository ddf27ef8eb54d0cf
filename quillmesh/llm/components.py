"""Connected components of a link table by alternating stars, wholly in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Label every node that has a link with the smallest node it can reach.

    ``links``: two long columns ``a`` and ``b``. Returns ``node``, ``label``. Rows with a null, loops and
    repeats are ignored; an empty table gives an empty result. Each round links every larger neighbour
    to the node's smallest neighbour (large star), then every smaller neighbour likewise (small star).
    The number of rounds grows with the logarithm of the longest path; the loop ends when no edge changed.
    Minima are pre-aggregated before each shuffle, so a hub with many neighbours costs no single task:
    the joins on the hub are split by adaptive execution. Only two sums come to the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = scratch.keep(edges)
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every row of ``large`` has v < u, so its smaller neighbours stand in v already
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new, new_path = scratch.keep(small.where("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(path)
        edges, path = new, new_path
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
