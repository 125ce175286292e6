"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.session import discard, materialize


def _stars(pairs: DataFrame, both: bool) -> DataFrame:
    """One star step on pairs (a > b).

    Large star: each node hands its smallest neighbour, or itself, to its larger neighbours.
    Small star: each node hands its smallest neighbour to its smaller ones and itself.
    Minima are partial aggregates, so a hub costs a task no more than its share of edges;
    the join back is one that adaptive execution may split.
    """
    if both:
        near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.withColumnRenamed("m", "b"))
    return out.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Each round is written to the shared folder, which cuts the lineage and leaves a state
    that outlives lost executors. The rounds stop when the edges no longer change; their
    number grows with the logarithm of the longest path. Self-loops and nulls are dropped,
    so nodes without an edge to another do not appear.
    """
    x, y = F.col(a), F.col(b)
    pairs = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    for _ in range(rounds):
        step = materialize(_stars(_stars(pairs, True), False), "edges")
        discard(pairs)
        pairs = step
        mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
