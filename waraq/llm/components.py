"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.runtime import drop_materialized, materialize

#: Groups of more than a SHARE-th of all rows, and of more than HOT rows, are fewer than SHARE, so that they are broadcast.
SHARE, HOT = 1000, 256


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``groups``, one small row per key, whose ``size`` counts the key's rows out of ``total``.
    ``how``: inner, or left to keep rows whose key has no group.

    ``groups`` is a written table. Groups of more than a ``SHARE``-th of all rows are broadcast and their rows stay where
    they are. The rows of all others are exchanged by key, of which none is hot. Small tables are not broadcast either:
    a broadcast stays on the executors until the driver's next garbage collection, and rounds of joins would fill them.
    """
    large = groups.filter(F.col(size) > max(total // SHARE, HOT))
    if large.isEmpty():
        return rows.join(groups.hint("merge"), keys, how)
    hot = rows.join(F.broadcast(large), keys)
    cold = rows.join(F.broadcast(large), keys, "left_anti").join(groups.filter(F.col(size) <= max(total // SHARE, HOT)).hint("merge"), keys, how)
    return hot.unionByName(cold)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Large star: neighbours above a node move to the node's smallest neighbour. Small star: those not above it do.

    ``total`` is about the number of edges; nodes with a large part of them meet their edges by broadcast."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    around = both.unionByName(both.select(F.col("m").alias("n"), F.col("n").alias("m"))) if large else both.select(F.greatest("n", "m").alias("n"), F.least("n", "m").alias("m"))
    low = around.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"), F.count(F.lit(1)).alias("size"))
    low = materialize(low, "lows", rows=2 * total)
    joined = join_groups(around, low, ["n"], "size", total)
    if large:
        moved = joined.filter("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("low").alias("v")))
    out = materialize(moved.filter("u <> v").distinct(), "edges", rows=2 * total)
    drop_materialized(low)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u: then each component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.filter((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0))).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has u and v. Returns node, root for each node with an edge to another; root is the smallest node.

    Each round is written to the shared folder, so lineage stays short. It stops when only stars around their smallest
    node are left, which one aggregate over the edges tells; the number of rounds grows with the logarithm of the
    longest chain.
    """
    at = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    total = at.count()
    if not total:
        return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        moved = _star(at, True, total)
        after = _star(moved, False, total)
        drop_materialized(at)
        drop_materialized(moved)
        at = after
        if _settled(at):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
