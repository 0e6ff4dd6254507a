"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

A node may have any share of all edges, as the centre of a star does. Its neighbours never meet in one task: they are split by a
hash into SALTS parts, each part gives its minimum, the minima of a node (SALTS of them at most) give the node's, and that goes back to the parts.

Defined results: edges from a node to itself and repeated edges change nothing, edges with a null end are ignored; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

SALTS = 256


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the least b of each a."""
    salted = edges.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    parts = parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))
    # Without the hint the planner may broadcast the minima, of which there are as many as nodes.
    return salted.join(parts.hint("merge"), ["a", "salt"]).select("a", "b", "m")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``edges`` (columns a, b).

    Each step is written to the shared folder, so lineage stays short and nothing but a count and a checksum comes to the driver;
    steps end when a round leaves the edges as they were.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, name)
    was = _state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        moved = with_least(cut(large, name))
        small = moved.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        e = cut(small.distinct(), name)
        now = _state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
