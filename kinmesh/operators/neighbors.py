"""Neighbour graphs over calibrated pairs (space, i, j, raw, cal)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR, FLOOR_QUANTILE, K = 0.28, 0.60, 4


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions as (space, src, dst, raw, cal)."""
    there = pairs.select("space", F.col("i").alias("src"), F.col("j").alias("dst"), "raw", "cal")
    return there.unionByName(pairs.select("space", F.col("j").alias("src"), F.col("i").alias("dst"), "raw", "cal"))


def similarity_floor(pairs: DataFrame) -> DataFrame:
    """(space, floor): the 60 % quantile of cal, 0.28 at least."""
    return pairs.groupBy("space").agg(F.greatest(F.lit(FLOOR), F.percentile("cal", FLOOR_QUANTILE)).alias("floor"))


def adaptive_topk(pairs: DataFrame, k: int = K) -> DataFrame:
    """Neighbours of each source by (cal, raw) downward, then id: those up to k + 2 above the local floor, the first k always.

    The local floor is max(0.72 floor, min(k-th cal, 72 % quantile) - 0.03).
    """
    by = Window.partitionBy("space", "src")
    ranked = mirrored(pairs).withColumn("rank", F.row_number().over(by.orderBy(F.desc("cal"), F.desc("raw"), "dst")))
    own = ranked.groupBy("space", "src").agg(F.percentile("cal", 0.72).alias("p72"), F.min(F.when(F.col("rank") <= k, F.col("cal"))).alias("kth"))
    near = ranked.filter(F.col("rank") <= k + 2).join(own, ["space", "src"]).join(F.broadcast(similarity_floor(pairs)), "space")
    local = F.greatest(0.72 * F.col("floor"), F.least("kth", "p72") - 0.03)
    kept = near.withColumn("local_floor", local).filter((F.col("rank") <= k) | (F.col("cal") >= F.col("local_floor")))
    return kept.select("space", "src", "dst", "rank", "raw", "cal", "local_floor")


def needs_quantile(m, k: int = K):
    """Whether the k + 2 largest of m values may lie below their 72 % quantile; m is a number or a column."""
    return 0.28 * (m - 1) < k + 1 + 1e-6


def chosen_topk(pairs: DataFrame, k: int = K) -> DataFrame:
    """:func:`adaptive_topk` without the local floors, for spaces with all their pairs.

    Of m values the k + 2 largest reach the 72 % quantile as soon as 0.28 (m - 1) >= k + 1, so the
    quantile is taken for sources of fewer pairs alone, and all others send k + 2 rows a part to the ranking.
    """
    by = Window.partitionBy("space", "src")
    both = mirrored(pairs)
    near = both.withColumn("rank", F.row_number().over(by.orderBy(F.desc("cal"), F.desc("raw"), "dst"))).filter(F.col("rank") <= k + 2)
    few = both.groupBy("space", "src").agg(F.count(F.lit(1)).alias("m")).filter(needs_quantile(F.col("m"), k)).select("space", "src")
    low = both.join(few, ["space", "src"], "left_semi").groupBy("space", "src").agg(F.percentile("cal", 0.72).alias("p72"))
    near = near.withColumn("kth", F.min(F.when(F.col("rank") <= k, F.col("cal"))).over(by))
    near = near.join(low, ["space", "src"], "left").join(F.broadcast(similarity_floor(pairs)), "space")
    local = F.greatest(0.72 * F.col("floor"), F.when(F.col("p72").isNotNull(), F.least("kth", "p72") - 0.03).otherwise(F.lit(0.0)))
    return near.filter((F.col("rank") <= k) | (F.col("cal") >= local)).select("space", "src", "dst", "rank", "raw", "cal")


def mutual_edges(neighbors: DataFrame) -> DataFrame:
    """(space, i, j, rank, raw, cal): undirected edges chosen from both ends; rank is that of the smaller id."""
    back = neighbors.select("space", F.col("src").alias("dst"), F.col("dst").alias("src"))
    both = neighbors.filter(F.col("src") < F.col("dst")).join(back, ["space", "src", "dst"], "left_semi")
    return both.select("space", F.col("src").alias("i"), F.col("dst").alias("j"), "rank", "raw", "cal")


def shared_neighbors(edges: DataFrame, neighbors: DataFrame) -> DataFrame:
    """``edges`` with shared: how many neighbours both ends chose."""
    own = neighbors.select("space", "src", "dst")
    a = edges.select("space", "i", "j").join(own.withColumnsRenamed({"src": "i", "dst": "via"}), ["space", "i"])
    met = a.join(own.withColumnsRenamed({"src": "j", "dst": "via"}), ["space", "j", "via"]).groupBy("space", "i", "j").agg(F.count(F.lit(1)).alias("shared"))
    return edges.join(met, ["space", "i", "j"], "left").fillna(0, ["shared"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, sid, degree) for all nodes (space, sid), 0 where none."""
    ends = edges.select("space", F.explode(F.array("i", "j")).alias("sid")).groupBy("space", "sid").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, ["space", "sid"], "left").fillna(0, ["degree"])


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).groupBy("space").agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def incident_top_edges(edges: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` heaviest edges of each node, ties by the other end."""
    there = edges.select("space", F.col("i").alias("sid"), F.col("j").alias("other"), "cal")
    all_ = there.unionByName(edges.select("space", F.col("j").alias("sid"), F.col("i").alias("other"), "cal"))
    rank = F.row_number().over(Window.partitionBy("space", "sid").orderBy(F.desc("cal"), "other"))
    return all_.withColumn("rank", rank).filter(F.col("rank") <= limit)
