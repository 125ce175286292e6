"""Whole engines over submissions: from chunk vectors, or from pairs, to graphs, clusters and documents.

All spaces of a run go through one plan with the space as a key; each shared table is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.functions.vectors import normalized, padded
from kinmesh.operators import clusters as C
from kinmesh.operators import neighbors as N
from kinmesh.operators import read_models as RM
from kinmesh.operators import similarity as S
from kinmesh.operators.reports import weighted_means
from kinmesh.operators.search import own_nearest, own_products
from kinmesh.session import materialize

#: Fixed value: the space of dense vectors.
EMBEDDING = "embedding"


def representations(submissions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(sid, v, chunks): the unit mean of a submission's chunk vectors by weight; zeros for one without a chunk.

    ``chunks`` are (sid, place, weight, v). Chunks whose size differs from their submission's
    first are left out, and shorter means are filled up with zeros, so all vectors have one size.
    """
    mean = weighted_means(chunks, "sid")
    size = mean.agg(F.coalesce(F.max(F.size("centroid")), F.lit(1)).alias("most"))
    counts = chunks.filter(F.col("v").isNotNull()).groupBy("sid").agg(F.count(F.lit(1)).alias("chunks"))
    df = submissions.select("sid").distinct().join(mean, "sid", "left").join(counts, "sid", "left").crossJoin(F.broadcast(size))  # one row
    v = padded(F.coalesce(normalized(F.col("centroid")), F.array().cast("array<double>")), F.col("most"))
    return df.select("sid", v.alias("v"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def embedding_pairs(vectors: DataFrame) -> DataFrame:
    """(space, i, j, raw, cal) of all i < j: the cosine within 0 and 1, six places; such pairs need no calibration."""
    met = own_products(vectors, "sid", "v")
    value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")), 6)
    return met.select(F.lit(EMBEDDING).alias("space"), "i", "j", value.alias("raw"), value.alias("cal"))


def graph_edges(vectors: DataFrame, k: int = N.K) -> DataFrame:
    """The edges that :func:`graph_stage` finds among all pairs of ``vectors`` (sid, v), none of which is written.

    Where :func:`kinmesh.operators.neighbors.chosen_topk` needs no quantile of single nodes, the best k + 2 of
    each node and the number of pairs of each value tell all; smaller sets go by their table of pairs.
    """
    n = vectors.filter(F.col("v").isNotNull()).count()
    if N.needs_quantile(n - 1, k):
        return N.mutual_edges(materialize(N.chosen_topk(materialize(embedding_pairs(vectors), "pairs"), k), "near"))
    near, counts = own_nearest(vectors, k + 2, "sid", "v")
    floor = counts.agg(F.greatest(F.lit(N.FLOOR), F.percentile("value", N.FLOOR_QUANTILE, F.col("n"))).alias("floor"))
    kept = near.crossJoin(F.broadcast(floor)).filter((F.col("rank") <= k) | (F.col("value") >= 0.72 * F.col("floor")))  # one row
    return N.mutual_edges(materialize(kept.select(F.lit(EMBEDDING).alias("space"), F.col("id").alias("src"), F.col("neighbor").alias("dst"), "rank", F.col("value").alias("raw"), F.col("value").alias("cal")), "near"))


def graph_stage(nodes: DataFrame, pairs: DataFrame, k: int = N.K) -> dict[str, DataFrame]:
    """Of each space: near, edges, degrees, floors, stats, members and spaces (the way its clusters were made)."""
    pairs = materialize(pairs, "pairs")
    near = materialize(N.adaptive_topk(pairs, k), "near")
    edges = materialize(N.shared_neighbors(N.mutual_edges(near), near), "edges")
    members, spaces = C.cluster_spaces(nodes, pairs, edges)
    return {"pairs": pairs, "near": near, "edges": edges, "degrees": N.degree_stats(nodes, edges), "floors": N.similarity_floor(pairs), "stats": S.similarity_stats(pairs), "members": members, "spaces": spaces}


def embedding_engine(submissions: DataFrame, chunks: DataFrame, k: int = N.K) -> dict[str, DataFrame]:
    """Chunk vectors to read models: representations, the tables of :func:`graph_stage`, and overview.

    Submissions are (sid), a whole number. One submission alone is a cluster; none give empty tables.
    """
    vectors = materialize(representations(submissions, chunks), "vectors")
    nodes = materialize(vectors.select(F.lit(EMBEDDING).alias("space"), "sid"), "nodes")
    out = graph_stage(nodes, embedding_pairs(vectors), k)
    return {"representations": vectors} | out | {"overview": RM.space_overview(out["members"], out["edges"], out["pairs"])}
