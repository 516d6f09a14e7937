"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one grouped minimum and one join, so a hub's neighbours are aggregated before the shuffle and no
component is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. ``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    joined = edges.join(least, F.col("u") == F.col("k")).select("v", "m").filter("v > m")
    return least.select(F.col("k").alias("u"), F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: for every node but the least of its component, that least node. ``edges`` are pairs ``u, v``.

    Self-links and rows with a null are ignored; repeated and reversed pairs count once. No edges give no rows.
    """
    edges = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == state:
            return edges
        state = (row["n"], row["h"])
        edges = cut(_small_star(_large_star(edges)))
