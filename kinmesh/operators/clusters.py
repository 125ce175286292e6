"""Clusters of a neighbour graph and what is told about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators.components import connected_components
from kinmesh.operators.neighbors import mirrored

COLORS = 8


def components_by_space(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, sid, component): the smallest sid reachable; nodes without edges are their own component.

    Space and sid travel as one struct, so all spaces are solved at once.
    """
    a, b = F.struct("space", F.col("i").alias("sid")), F.struct("space", F.col("j").alias("sid"))
    found = connected_components(edges.select(a.alias("a"), b.alias("b")))
    flat = found.select("node.space", "node.sid", F.col("component.sid").alias("component"))
    return nodes.join(flat, ["space", "sid"], "left").withColumn("component", F.coalesce("component", "sid"))


def strong_edges(edges: DataFrame) -> DataFrame:
    """Edges above the strong floor, or above the medium floor with a shared neighbour (needs column shared)."""
    floors = edges.groupBy("space").agg(F.greatest(F.lit(0.0), F.percentile("cal", 0.68) - 0.02).alias("strong"), F.greatest(F.lit(0.0), F.percentile("cal", 0.55) - 0.01).alias("medium"))
    kept = (F.col("cal") >= F.col("strong")) | ((F.col("shared") >= 1) & (F.col("cal") >= F.col("medium")))
    return edges.join(F.broadcast(floors), "space").filter(kept).drop("strong", "medium")


def component_density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, component, size, edges, density): edges inside over the possible ones, 1 for a single node."""
    sizes = members.groupBy("space", "component").agg(F.count(F.lit(1)).alias("size"))
    own = members.select("space", F.col("sid").alias("i"), "component")
    other = members.select("space", F.col("sid").alias("j"), F.col("component").alias("component_j"))
    inside = edges.join(own, ["space", "i"]).join(other, ["space", "j"]).filter(F.col("component") == F.col("component_j"))
    counts = inside.groupBy("space", "component").agg(F.count(F.lit(1)).alias("edges"))
    df = sizes.join(counts, ["space", "component"], "left").fillna(0, ["edges"])
    return df.withColumn("density", F.when(F.col("size") < 2, 1.0).otherwise(F.round(F.try_divide(F.col("edges") * 2.0, F.col("size") * (F.col("size") - 1)), 6)))


def fallback_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, sid, cluster, is_noise, strength): components of strong edges; singles and thin components are noise.

    ``cluster`` is the smallest sid (null for noise), strength a member's mean strong edge.
    """
    strong = strong_edges(edges)
    members = components_by_space(nodes, strong)
    density = component_density(members, strong).withColumn("noise", (F.col("size") < 2) | (F.col("density") < F.when(F.col("space") == "struct", 0.34).otherwise(0.28)))
    there = strong.select("space", F.col("i").alias("sid"), "cal").unionByName(strong.select("space", F.col("j").alias("sid"), "cal"))
    strength = there.groupBy("space", "sid").agg(F.avg("cal").alias("strength"))
    df = members.join(density.select("space", "component", "noise"), ["space", "component"]).join(strength, ["space", "sid"], "left")
    return df.select("space", "sid", F.when(~F.col("noise"), F.col("component")).alias("cluster"), F.col("noise").alias("is_noise"), F.when(~F.col("noise"), F.round("strength", 6)).otherwise(0.0).alias("strength"))


def inside_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with cluster_i, cluster_j (null outside clusters); members are (space, sid, cluster)."""
    a = members.select("space", F.col("sid").alias("i"), F.col("cluster").alias("cluster_i"))
    b = members.select("space", F.col("sid").alias("j"), F.col("cluster").alias("cluster_j"))
    return pairs.join(a, ["space", "i"]).join(b, ["space", "j"])


def cluster_metrics(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(space, cluster, size, avg_similarity, span); 1 and 0 for a single member."""
    sizes = members.filter(F.col("cluster").isNotNull()).groupBy("space", "cluster").agg(F.count(F.lit(1)).alias("size"))
    inside = inside_pairs(members, pairs).filter(F.col("cluster_i") == F.col("cluster_j")).groupBy("space", F.col("cluster_i").alias("cluster"))
    found = inside.agg(F.avg("cal").alias("avg_similarity"), F.max(F.greatest(F.lit(0.0), 1 - F.col("cal"))).alias("span"))
    return sizes.join(found, ["space", "cluster"], "left").fillna({"avg_similarity": 1.0, "span": 0.0})


def decorate(metrics: DataFrame) -> DataFrame:
    """``metrics`` with label C1.. by size, then similarity downward, and a colour of eight in turn."""
    rank = F.row_number().over(Window.partitionBy("space").orderBy(F.desc("size"), F.desc("avg_similarity"), "cluster"))
    return metrics.withColumn("order", rank).withColumn("label", F.concat(F.lit("C"), F.col("order").cast("string"))).withColumn("color", F.pmod(F.col("order") - 1, F.lit(COLORS)).cast("int"))


def cluster_pair_summaries(members: DataFrame, pairs: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` most similar pairs inside each cluster and across its border."""
    both = inside_pairs(members, pairs)
    inside = both.filter(F.col("cluster_i") == F.col("cluster_j")).select("space", F.col("cluster_i").alias("cluster"), F.lit("internal").alias("kind"), "i", "j", "cal")
    out = both.filter(~F.col("cluster_i").eqNullSafe(F.col("cluster_j")))
    outside = out.select("space", F.explode(F.array("cluster_i", "cluster_j")).alias("cluster"), F.lit("external").alias("kind"), "i", "j", "cal").filter(F.col("cluster").isNotNull())
    rank = F.row_number().over(Window.partitionBy("space", "cluster", "kind").orderBy(F.desc("cal"), "i", "j"))
    return inside.unionByName(outside).withColumn("rank", rank).filter(F.col("rank") <= limit)


def central_members(members: DataFrame, pairs: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` members of each cluster with the largest mean similarity to the others (1 if alone)."""
    own = members.filter(F.col("cluster").isNotNull()).select("space", "sid", "cluster")
    there = mirrored(pairs).join(own.withColumnRenamed("sid", "src"), ["space", "src"])
    other = own.select("space", F.col("sid").alias("dst"), F.col("cluster").alias("other"))
    mean = there.join(other, ["space", "dst"]).filter(F.col("cluster") == F.col("other")).groupBy("space", F.col("src").alias("sid")).agg(F.avg("cal").alias("mean"))
    df = own.join(mean, ["space", "sid"], "left").fillna(1.0, ["mean"])
    rank = F.row_number().over(Window.partitionBy("space", "cluster").orderBy(F.desc("mean"), "sid"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= limit)


def exemplars(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(space, cluster, exemplar): the member of the largest sum of similarities to the others times its strength, 0.1 at least; ties by sid."""
    own = members.filter(F.col("cluster").isNotNull()).select("space", "sid", "cluster", F.greatest(F.lit(0.1), "strength").alias("strength"))
    there = mirrored(pairs).join(own.withColumnRenamed("sid", "src"), ["space", "src"])
    other = own.select("space", F.col("sid").alias("dst"), F.col("cluster").alias("other"))
    sums = there.join(other, ["space", "dst"]).filter(F.col("cluster") == F.col("other")).groupBy("space", F.col("src").alias("sid")).agg(F.sum("cal").alias("near"))
    df = own.join(sums, ["space", "sid"], "left").withColumn("score", F.round(F.coalesce("near", F.lit(0.0)) * F.col("strength"), 9))
    return df.groupBy("space", "cluster").agg(F.min_by("sid", F.struct(-F.col("score"), "sid")).alias("exemplar"))


def cluster_report(members: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, cluster, size, internal_density, avg_similarity, mean_strength, span, exemplar, method), and with a null cluster
    the noise of a space: its size and mean outlier score 1 - strength.

    A space of one submission is a cluster of method singleton with all metrics 1 and span 0.
    """
    n = members.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    df = members.join(n, "space")
    alone = F.col("n") == 1
    df = df.withColumn("cluster", F.when(alone, F.col("sid")).otherwise(F.col("cluster"))).withColumn("strength", F.when(alone, 1.0).otherwise(F.col("strength")))
    inner = df.filter(F.col("cluster").isNotNull())
    density = component_density(inner.select("space", "sid", F.col("cluster").alias("component")), edges).select("space", F.col("component").alias("cluster"), F.col("density").alias("internal_density"))
    strength = inner.groupBy("space", "cluster").agg(F.round(F.avg("strength"), 6).alias("mean_strength"), F.max("n").alias("n"))
    found = cluster_metrics(df, pairs).join(density, ["space", "cluster"]).join(strength, ["space", "cluster"]).join(exemplars(df, pairs), ["space", "cluster"])
    method = F.when(F.col("n") == 1, "singleton").otherwise("graph_support_components")
    found = found.select("space", "cluster", "size", "internal_density", "avg_similarity", "mean_strength", "span", "exemplar", method.alias("method"), F.lit(None).cast("double").alias("outlier_score"))
    noise = df.filter(F.col("cluster").isNull()).groupBy("space").agg(F.count(F.lit(1)).alias("size"), F.avg(1 - F.col("strength")).alias("outlier_score"))
    return found.unionByName(noise.withColumn("method", F.lit("noise")), allowMissingColumns=True)


def signature_lift(members: DataFrame, weighted: DataFrame, top: int = 8, low: int = 5) -> DataFrame:
    """Feature lift of each cluster: mean over members less mean over the rest, absent features as 0.

    The ``top`` largest positive and the ``low`` most negative ones. Sums over the rest are
    the space's sums less the cluster's, so no member meets a feature that it lacks.
    """
    own = members.filter(F.col("cluster").isNotNull()).select("space", "sid", "cluster")
    n = members.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("space", "cluster").agg(F.count(F.lit(1)).alias("m")).join(n, "space")
    total = weighted.groupBy("space", "feature").agg(F.sum("w").alias("total"))
    inside = weighted.join(own, ["space", "sid"]).groupBy("space", "cluster", "feature").agg(F.sum("w").alias("own"))
    grid = sizes.join(total, "space").join(inside, ["space", "cluster", "feature"], "left").fillna(0.0, ["own"]).filter(F.col("total") > 0)
    rest = F.when(F.col("n") > F.col("m"), (F.col("total") - F.col("own")) / F.greatest(F.col("n") - F.col("m"), F.lit(1))).otherwise(0.0)
    lift = grid.withColumn("lift", F.round(F.col("own") / F.col("m") - rest, 6)).filter(F.col("lift") != 0)
    kind = F.when(F.col("lift") > 0, "signature").otherwise("contrast")
    rank = F.row_number().over(Window.partitionBy("space", "cluster", "kind").orderBy(F.desc(F.abs("lift")), "feature"))
    return lift.withColumn("kind", kind).withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("kind") == "signature", top).otherwise(low)).select("space", "cluster", "kind", "rank", "feature", "lift")


def graph_nodes(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with cluster, is_noise, strength and their degree."""
    from kinmesh.operators.neighbors import degrees

    return degrees(nodes, edges).join(members, ["space", "sid"], "left")


def cluster_spaces(nodes: DataFrame, pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((space, sid, cluster, is_noise, strength), (space, method, fallback, reason, n, clusters, noise, least, samples, probe)): each space by the way that fits it.

    singleton                 a space of one node is one cluster
    connected_components      a space with a pair that has no number cannot be clustered by density; components of its edges stand in
    hdbscan_precomputed       density clusters, the rest is noise; also where all is noise and the edges give nothing
    graph_support_components  all is noise, but strong edges hold clusters together

    The way is chosen by aggregates over each space, so all spaces run in one plan. ``cluster``
    is the smallest sid in it. Nodes are (space, sid), pairs (space, i, j, cal), edges
    (space, i, j, cal, shared). least, samples and probe (the 75 % quantile
    of cal) are the parameters of density clusters and null for the other ways.
    """
    from kinmesh.operators import density as D
    from kinmesh.session import materialize

    n = nodes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    broken = pairs.groupBy("space").agg(F.bool_or(F.col("cal").isNull() | F.isnan("cal")).alias("broken"), F.percentile("cal", 0.75).alias("probe"))
    told = n.join(broken, "space", "left").withColumn("way", F.when(F.col("n") == 1, "singleton").when(F.coalesce("broken", F.lit(False)), "connected_components").otherwise("density"))
    told = materialize(told.select("space", "n", "way", F.when(F.col("way") == "density", F.col("probe")).alias("probe")), "spaces")
    of = lambda df, way: df.join(told.filter(F.col("way") == way).select("space"), "space")

    dense = D.density_clusters(of(nodes, "density"), of(pairs, "density"))
    least = F.when(F.col("label") >= 0, F.min("sid").over(Window.partitionBy("space", "label")))
    dense = materialize(dense.select("space", "sid", least.alias("cluster"), "probability"), "dense")
    held = dense.groupBy("space").agg(F.count("cluster").alias("held"))
    empty = held.filter("held = 0").select("space")
    graph = materialize(fallback_clusters(of(nodes, "density").join(empty, "space"), of(edges, "density").join(empty, "space")), "graph")
    found = graph.groupBy("space").agg(F.count("cluster").alias("kept")).filter("kept > 0").select("space")

    alone = of(nodes, "singleton").select("space", "sid", F.col("sid").alias("cluster"), F.lit(1.0).alias("strength"))
    parts = components_by_space(of(nodes, "connected_components"), of(edges, "connected_components")).select("space", "sid", F.col("component").alias("cluster"), F.lit(1.0).alias("strength"))
    by_density = dense.join(found, "space", "left_anti").select("space", "sid", "cluster", F.col("probability").alias("strength"))
    by_graph = graph.join(found, "space").select("space", "sid", "cluster", "strength")
    members = materialize(alone.unionByName(parts).unionByName(by_density).unionByName(by_graph).select("space", "sid", "cluster", F.col("cluster").isNull().alias("is_noise"), "strength"), "members")

    counts = members.groupBy("space").agg(F.countDistinct("cluster").alias("clusters"), F.count_if("is_noise").alias("noise"))
    lifted = found.withColumn("graph", F.lit(True))
    rows = told.join(counts, "space").join(lifted, "space", "left")
    method = F.when(F.col("way") != "density", F.col("way")).when(F.col("graph"), "graph_support_components").otherwise("hdbscan_precomputed")
    reason = F.when(F.col("way") == "connected_components", "hdbscan_unavailable_or_failed").when(F.col("graph"), "all_noise_graph_support_fallback")
    density = F.col("way") == "density"
    size = F.when(density, F.greatest(F.lit(2), F.least(F.col("n"), F.greatest(F.lit(2), F.least(F.lit(12), F.bround(F.sqrt(F.greatest(F.lit(2), F.col("n"))))))))).cast("bigint")
    spaces = rows.select("space", method.alias("method"), reason.isNotNull().alias("fallback"), reason.alias("reason"), "n", "clusters", "noise", size.alias("least"), F.when(density, F.greatest(F.lit(1), F.least(F.floor(size / 2), F.greatest(F.lit(1), F.col("n") - 1)))).cast("bigint").alias("samples"), F.round("probe", 6).alias("probe"))
    return members, spaces
