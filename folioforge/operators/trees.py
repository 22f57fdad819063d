"""Trees by pointer doubling: every round each node's pointer jumps over as many nodes as in all rounds before, so rounds grow with the logarithm of the depth.

Trees are frames (id, parent_id); a null parent makes a root, and several roots a forest. Rounds end in a checkpoint, so
a lost executor costs one round. No depth is too great and no node is walked down to from the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.executors import cut


def path_sums(tree: DataFrame, **weights: Column) -> DataFrame:
    """id, root, and each of ``weights`` (expressions over ``tree``) summed over the node and all above it. Nodes that reach no root (on or below a cycle, or below a missing parent) have null for root and sums."""
    names, kind = list(weights), tree.schema["id"].dataType
    current = tree.select("id", F.col("parent_id").alias("at"), F.lit(None).cast(kind).alias("root"), F.lit(False).alias("lost"), *[w.cast("bigint").alias(n) for n, w in weights.items()])
    current = cut(current)
    for _ in range(current.count().bit_length() + 1):  # after as many rounds only what is on a cycle or below one still moves
        if current.where("at is not null").isEmpty():
            break
        above = current.select(F.col("id").alias("at"), F.col("at").alias("next"), F.coalesce("root", "id").alias("top"), F.col("lost").alias("gone"), *[F.col(n).alias(f"_{n}") for n in names])
        going = F.col("at").isNotNull()
        ends = going & F.col("next").isNull()
        moved = current.join(above, "at", "left").select(
            "id", F.col("next").alias("at"), F.when(ends & ~F.col("gone"), F.col("top")).otherwise(F.col("root")).alias("root"), (F.col("lost") | (ends & F.coalesce("gone", F.lit(True)))).alias("lost"),
            *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names],
        )
        current = cut(moved)
    reached = F.col("at").isNull() & ~F.col("lost")
    return current.select("id", F.when(reached, F.coalesce("root", "id")).alias("root"), *[F.when(reached, F.col(n)).alias(n) for n in names])


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """id, size: the nodes at and below each node (of a tree without cycles)."""
    current = cut(tree.select("id", F.col("parent_id").alias("at"), F.lit(1).cast("bigint").alias("size")))
    while not current.where("at is not null").isEmpty():
        below = current.where("at is not null").groupBy(F.col("at").alias("id")).agg(F.sum("size").alias("more"))
        jump = current.select(F.col("id").alias("at"), F.col("at").alias("next"))
        moved = current.join(jump, "at", "left").join(below, "id", "left")
        current = cut(moved.select("id", F.col("next").alias("at"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return current.select("id", "size")


def preorder(tree: DataFrame) -> DataFrame:
    """id, depth (0 for roots), position (from 1) in pre-order, children by id. A node's position is the sum, over it and all above it, of one and the sizes of earlier siblings' subtrees."""
    sized = tree.select("id", "parent_id").join(subtree_sizes(tree), "id")
    earlier = Window.partitionBy("parent_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    steps = cut(sized.select("id", "parent_id", (1 + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("step")))
    sums = path_sums(steps, depth=F.lit(1), position=F.col("step"))
    return sums.select("id", (F.col("depth") - 1).alias("depth"), "position")


def nearest_kept(tree: DataFrame, kept: Column) -> DataFrame:
    """id, parent_id of the kept nodes, where the parent is the nearest kept node above; null where there is none."""
    nodes = tree.select("id", "parent_id", kept.alias("kept"))
    stops = path_sums(nodes.select("id", F.when(~F.col("kept"), F.col("parent_id")).alias("parent_id"), "kept"))
    stops = stops.join(nodes.where("kept").select(F.col("id").alias("root")), "root", "left_semi")
    return nodes.where("kept").select("id", F.col("parent_id").alias("above")).join(stops.select(F.col("id").alias("above"), F.col("root").alias("parent_id")), "above", "left").select("id", "parent_id")
