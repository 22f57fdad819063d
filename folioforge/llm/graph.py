"""Connected components as joins: alternating large-star and small-star rounds until only stars are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.storage import Scratch


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) neighbours with u's least neighbour or itself as m. Aggregated first, so a hub costs one row a task."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _settled(pairs: DataFrame) -> bool:
    """Whether every node is the least of its group or has one pair, with the least: then another round changes nothing."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(1).alias("above")))
    return not ends.groupBy("node").agg(F.sum("above").alias("above"), F.count("*").alias("n")).where("above > 0 and n > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, scratch: Scratch, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``edges``: two integer columns ``a`` and ``b``. Returns ``node`` and ``component``, the least node reachable, for every node of an edge.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows. Rounds grow with the logarithm of
    the longest path; labels that still change after ``max_rounds`` are an error, never a result.
    """
    current = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{label}-0")
    for k in range(1, max_rounds + 1):
        if _settled(current):
            break
        if k == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _toward_minimum(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        current = scratch.save(small, f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    stars = current.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
