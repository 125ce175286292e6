"""Read models: one nested document for each submission, fused pair and space, from ranked, bounded lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators.neighbors import incident_top_edges
from kinmesh.operators.similarity import FUSION_BASE

#: Entries of a document's lists.
NEIGHBORS, SIGNALS = 5, 8


def _ranked(df: DataFrame, keys: list[str], most: int, fields: list[str], name: str) -> DataFrame:
    """The first ``most`` rows of each key by ``rank`` as a list; ranks are cut before the shuffle."""
    return df.filter(F.col("rank") <= most).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def submission_documents(members: DataFrame, edges: DataFrame, weighted: DataFrame, neighbors: int = NEIGHBORS, signals: int = SIGNALS) -> DataFrame:
    """(sid, spaces): of each space the submission's cluster, strength, degree, nearest neighbours and heaviest features.

    Lists hold ``neighbors`` and ``signals`` entries at most; the parts of a submission meet in
    one shuffle by its id.
    """
    ends = edges.select("space", F.explode(F.array("i", "j")).alias("sid")).groupBy("space", "sid").agg(F.count(F.lit(1)).alias("degree"))
    near = _ranked(incident_top_edges(edges, neighbors), ["space", "sid"], neighbors, ["other", "cal"], "neighbors")
    by = Window.partitionBy("space", "sid").orderBy(F.desc(F.abs("w")), "feature")
    heavy = _ranked(weighted.filter("w <> 0").withColumn("rank", F.row_number().over(by)), ["space", "sid"], signals, ["feature", "w"], "signals")
    rows = members.join(ends, ["space", "sid"], "left").fillna(0, ["degree"]).join(near, ["space", "sid"], "left").join(heavy, ["space", "sid"], "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])).alias(c)
    part = F.struct("space", "cluster", "is_noise", "strength", "degree", none("neighbors"), none("signals"))
    return rows.groupBy("sid").agg(F.sort_array(F.collect_list(part)).alias("spaces"))  # a part a space


def fusion_pair_documents(pairs: DataFrame, fused: DataFrame, profile: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, raw, cal, n_support, sources, strongest, edge): each fused pair with what each space gave to it.

    sources are (space, raw, cal, weight, share, supports), the largest share of the mean first;
    edge is the weight of the fused graph's edge, null where it has none.
    """
    spaces = list(FUSION_BASE)
    wide = pairs.filter(F.col("space").isin(*spaces)).groupBy("i", "j").agg(*[F.max(F.when(F.col("space") == s, F.col(v))).alias(f"{v}_{s}") for s in spaces for v in ("raw", "cal")])
    df = fused.join(wide, ["i", "j"]).crossJoin(F.broadcast(profile.select(*[f"{p}_{s}" for p in "wt" for s in spaces])))  # one row
    total = reduce(lambda a, b: a + b, [F.col(f"w_{s}") * F.col(f"cal_{s}") for s in spaces])
    share = lambda s: F.when(total > 0, F.col(f"w_{s}") * F.col(f"cal_{s}") / total).otherwise(0.0)
    parts = F.array(*[F.struct((-F.round(share(s), 6)).alias("order"), F.lit(s).alias("space"), F.col(f"raw_{s}").alias("raw"), F.col(f"cal_{s}").alias("cal"), F.col(f"w_{s}").alias("weight"), F.round(share(s), 6).alias("share"), (F.col(f"cal_{s}") >= F.col(f"t_{s}")).alias("supports")) for s in spaces])
    fields = ("space", "raw", "cal", "weight", "share", "supports")
    sources = F.transform(F.sort_array(parts), lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    drawn = edges.select("i", "j", F.col("cal").alias("edge"))
    out = df.withColumn("sources", sources).join(drawn, ["i", "j"], "left")
    return out.select("i", "j", "raw", "cal", "n_support", "sources", F.col("sources")[0]["space"].alias("strongest"), "edge")


def space_overview(members: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(space, nodes, edges, clusters, noise, pairs, mean): what each space holds."""
    own = members.groupBy("space").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("cluster").alias("clusters"), F.count_if("is_noise").alias("noise"))
    drawn = edges.groupBy("space").agg(F.count(F.lit(1)).alias("edges"))
    scored = pairs.groupBy("space").agg(F.count(F.lit(1)).alias("pairs"), F.avg("cal").alias("mean"))
    return own.join(drawn, "space", "left").join(scored, "space", "left").fillna(0, ["edges", "pairs"]).select("space", "nodes", "edges", "clusters", "noise", "pairs", "mean")
