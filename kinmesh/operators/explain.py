"""Rule-based explanations of pairs from their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.features import AGREEMENT, family_label, feature_family, humanize_feature


def pair_differences(weighted: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """(space, i, j, rank, feature, left, right, gap, dominant): the ``limit`` widest gaps of each pair, features of one side alone included.

    Each side's features meet the pair once and are summed by feature, so an absent one is 0.
    The side of the larger weight is dominant, the first where they are equal.
    """
    own = weighted.filter(F.col("w") != 0).select("space", "sid", "feature", "w")
    keys = pairs.select("space", "i", "j")
    zero = F.lit(0.0)
    left = keys.join(own.withColumnRenamed("sid", "i"), ["space", "i"]).select("space", "i", "j", "feature", F.col("w").alias("left"), zero.alias("right"))
    right = keys.join(own.withColumnRenamed("sid", "j"), ["space", "j"]).select("space", "i", "j", "feature", zero.alias("left"), F.col("w").alias("right"))
    both = left.unionByName(right).groupBy("space", "i", "j", "feature").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    both = both.withColumn("gap", F.round(F.abs(F.col("left") - F.col("right")), 6))
    rank = F.row_number().over(Window.partitionBy("space", "i", "j").orderBy(F.desc("gap"), "feature"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= limit).withColumn("dominant", F.when(F.col("left") >= F.col("right"), F.col("i")).otherwise(F.col("j")))


def pair_contributions(weighted: DataFrame, pairs: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` strongest common features of each pair: product of weights over product of norms."""
    own = weighted.groupBy("space", "sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = weighted.filter(F.col("w") > 0).join(own, ["space", "sid"]).select("space", "sid", "feature", "w", "norm")
    a = side.withColumnsRenamed({"sid": "i", "w": "wi", "norm": "ni"})
    b = side.withColumnsRenamed({"sid": "j", "w": "wj", "norm": "nj"})
    # a pair meets the features of one side, and those the other side: no feature that all have meets all pairs
    met = pairs.select("space", "i", "j").join(a, ["space", "i"]).join(b, ["space", "j", "feature"])
    value = F.col("wi") * F.col("wj") / (F.col("ni") * F.col("nj"))
    rank = F.row_number().over(Window.partitionBy("space", "i", "j").orderBy(F.desc("contribution"), "feature"))
    return met.select("space", "i", "j", "feature", value.alias("contribution")).withColumn("rank", rank).filter(F.col("rank") <= limit)


def relation_label(cal: Column) -> Column:
    return F.when(cal >= 0.82, "stark").when(cal >= 0.6, "mittel").when(cal >= 0.4, "locker").otherwise("schwach")


def verdict(cal: Column, strength: Column) -> Column:
    return F.when(strength <= 0, "kaum sichtbar").when(cal >= 0.82, "hoch").when(cal >= 0.6, "mittel").otherwise("schwach")


def explain_pairs(pairs: DataFrame, contributions: DataFrame, components: DataFrame) -> DataFrame:
    """(space, i, j, relation, dominant_family, strength, verdict, strongest_component, summary).

    The dominant family has the largest sum over the first eight common features.
    """
    families = contributions.filter(F.col("rank") <= 8).withColumn("family", feature_family(F.col("feature"))).groupBy("space", "i", "j", "family").agg(F.sum("contribution").alias("strength"))
    first = F.row_number().over(Window.partitionBy("space", "i", "j").orderBy(F.desc("strength"), "family"))
    lead = families.withColumn("n", first).filter(F.col("n") == 1).select("space", "i", "j", F.col("family").alias("dominant_family"), "strength")
    names = ("profile", "contrast", "overlap", "size", "rare_overlap")
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(-k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(names)]))["name"]
    df = pairs.join(lead, ["space", "i", "j"], "left").join(components.select("space", "i", "j", best.alias("strongest_component")), ["space", "i", "j"])
    df = df.withColumn("relation", relation_label(F.col("cal"))).withColumn("verdict", verdict(F.col("cal"), F.coalesce("strength", F.lit(0.0))))
    basis = F.coalesce("dominant_family", F.lit("wenige klare Signale"))
    summary = F.format_string("Diese Paarung ist %s und wird vor allem durch %s getragen. Dominanter Score-Baustein: %s.", "relation", basis, "strongest_component")
    return df.select("space", "i", "j", "relation", "dominant_family", "strength", "verdict", "strongest_component", summary.alias("summary"))


def pair_reports(pairs: DataFrame, contributions: DataFrame, differences: DataFrame, components: DataFrame) -> DataFrame:
    """(space, i, j, summary, dominant_families, agreement, shared, different): what carries a pair and what parts it.

    The two families of largest positive strength over the first eight common features are
    dominant. ``agreement`` tells each family of the space's profile with its strength, verdict
    and up to three features as evidence; ``shared`` and ``different`` are the first five signals.
    """
    keys = ["space", "i", "j"]
    told = contributions.filter(F.col("rank") <= 8).withColumn("family", feature_family(F.col("feature"))).withColumn("label", humanize_feature(F.col("feature")))
    families = told.groupBy(*keys, "family").agg(F.sum("contribution").alias("strength"), F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("evidence"))
    held = F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("less"), "first", "family", F.slice(F.transform("evidence", lambda e: e["label"]), 1, 3).alias("evidence"))))
    families = families.groupBy(*keys).agg(held.alias("fs"))  # at most eight entries
    shared = told.filter(F.col("rank") <= 5).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "label", "family", F.round("contribution", 6).alias("contribution")))).alias("shared"))
    apart = differences.filter(F.col("rank") <= 5).select(*keys, F.struct("rank", "feature", humanize_feature(F.col("feature")).alias("label"), feature_family(F.col("feature")).alias("family"), F.round("gap", 6).alias("gap")).alias("d"))
    apart = apart.groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("different"))
    names = ("profile", "contrast", "overlap", "size", "rare_overlap")
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(-k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(names)]))["name"]
    df = pairs.join(families, keys, "left").join(shared, keys, "left").join(apart, keys, "left").join(components.select(*keys, best.alias("strongest")), keys, "left")
    dominant = F.filter(F.slice(F.coalesce("fs", F.array().cast(families.schema["fs"].dataType)), 1, 2), lambda f: f["less"] < 0)
    df = df.withColumn("dominant_families", F.transform(dominant, lambda f: family_label(f["family"])))
    basis = F.when(F.size("dominant_families") > 0, F.array_join("dominant_families", ", ")).otherwise("wenige klare Signale")
    # The sentences' wording.
    summary = F.concat(F.lit("Diese Paarung ist "), relation_label(F.col("cal")), F.lit(" und wird vor allem durch "), basis, F.lit(" getragen."))
    summary = F.when(F.col("strongest").isNull(), summary).otherwise(F.concat(summary, F.lit(" Dominanter Score-Baustein: "), F.col("strongest"), F.lit(".")))
    return df.withColumn("agreement", agreement_profile(F.col("space"), F.col("cal"), F.col("fs"))).select(*keys, summary.alias("summary"), "dominant_families", "agreement", "shared", "different")


def agreement_profile(space: Column, cal: Column, families: Column) -> Column:
    """An array of (dimension, label, strength, verdict, evidence) for the families of the space; empty for other spaces."""

    def row(family: str, label: str) -> Column:
        own = F.get(F.filter(families, lambda f: f["family"] == family), F.lit(0))
        strength = F.coalesce(-own["less"], F.lit(0.0))
        evidence = F.coalesce(own["evidence"], F.array().cast("array<string>"))
        return F.struct(F.lit(family).alias("dimension"), F.lit(label).alias("label"), F.round(strength, 6).alias("strength"), verdict(cal, strength).alias("verdict"), evidence.alias("evidence"))

    out = F.array().cast("array<struct<dimension:string,label:string,strength:double,verdict:string,evidence:array<string>>>")
    for name, dimensions in AGREEMENT.items():
        out = F.when(space == name, F.array(*[row(*d) for d in dimensions])).otherwise(out)
    return out


def _story(pairs: DataFrame, kind: str, most: int = 3) -> DataFrame:
    line = F.format_string("%s ↔ %s (%.3f)", F.col("i").cast("string"), F.col("j").cast("string"), "cal")
    held = pairs.filter((F.col("kind") == kind) & (F.col("rank") <= most)).groupBy("space", "cluster").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("s"))
    return held.select("space", "cluster", F.transform("s", lambda e: e["line"]).alias(f"{kind}_story"))


def explain_clusters(metrics: DataFrame, lifts: DataFrame, central: DataFrame, pair_summaries: DataFrame) -> DataFrame:
    """(space, cluster, summary, dominant_families, cohesion_basis, boundary_basis, core_members, internal_story, external_story).

    ``metrics`` have density, avg_similarity and span. The three most frequent families of the
    first eight signature features are dominant, ties in order of their first feature.
    """
    keys = ["space", "cluster"]
    told = lifts.withColumns({"label": humanize_feature(F.col("feature")), "family": feature_family(F.col("feature"))})
    fams = told.filter((F.col("kind") == "signature") & (F.col("rank") <= 8)).groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    fams = fams.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "family"))).alias("fs"))
    fams = fams.select(*keys, F.transform(F.slice("fs", 1, 3), lambda f: family_label(f["family"])).alias("dominant_families"))
    basis = lambda kind, most, name: told.filter((F.col("kind") == kind) & (F.col("rank") <= most)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "label", "family", "lift"))).alias(name))
    core = central.filter(F.col("rank") <= 3).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("sid").cast("string").alias("sid")))), lambda e: e["sid"]).alias("core_members"))
    df = metrics
    for part in (fams, basis("signature", 5, "cohesion_basis"), basis("contrast", 4, "boundary_basis"), core, _story(pair_summaries, "internal"), _story(pair_summaries, "external")):
        df = df.join(part, keys, "left")
    # The sentences' wording.
    grip = F.when((F.col("density") >= 0.66) & (F.col("avg_similarity") >= 0.72), "eng").when(F.col("density") >= 0.4, "mittel").otherwise("locker")
    carried = F.when(F.size("dominant_families") > 0, F.array_join("dominant_families", ", ")).otherwise("gemischte Signale")
    summary = F.concat(F.lit("Das Cluster ist "), grip, F.lit(" und hält vor allem über "), carried, F.lit(" zusammen."))
    summary = F.when(F.size("core_members") > 0, F.concat(summary, F.lit(" Typische Vertreter sind "), F.array_join("core_members", ", "), F.lit("."))).otherwise(summary)
    wide = F.lit(" Es gibt aber spürbare interne Varianz, also eher eine Lösungsfamilie als einen Near-Duplicate-Block.")
    summary = F.when(F.col("span") >= 0.45, F.concat(summary, wide)).otherwise(summary)
    return df.select(*keys, summary.alias("summary"), "dominant_families", "cohesion_basis", "boundary_basis", "core_members", "internal_story", "external_story")


def explain_submissions(members: DataFrame, top_edges: DataFrame, sizes: DataFrame, lifts: DataFrame) -> DataFrame:
    """(space, sid, summary, neighbor_story, why_here, why_not_else) of each member (space, sid, cluster, is_noise).

    ``top_edges`` are (space, sid, rank, other, cal, edge_type), ``sizes`` (space, cluster, label, size).
    A submission without membership is told to have no place yet.
    """
    name = F.col("sid").cast("string")
    shown = F.when(F.col("is_noise"), F.format_string("%s (%.3f)", F.col("other").cast("string"), "cal")).otherwise(F.format_string("%s (%.3f, %s)", F.col("other").cast("string"), "cal", "edge_type"))
    near = top_edges.join(members.select("space", "sid", "is_noise"), ["space", "sid"]).filter(F.col("rank") <= F.when(F.col("is_noise"), 3).otherwise(4))
    near = near.groupBy("space", "sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", shown.alias("line")))), lambda e: e["line"]).alias("neighbor_story"))
    labels = lambda kind, most, to: lifts.filter((F.col("kind") == kind) & (F.col("rank") <= most)).groupBy("space", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", humanize_feature(F.col("feature")).alias("l")))), lambda e: e["l"]).alias(to))
    df = members.join(near, ["space", "sid"], "left").join(sizes.select("space", "cluster", "label", "size"), ["space", "cluster"], "left")
    df = df.join(labels("signature", 4, "here"), ["space", "cluster"], "left").join(labels("contrast", 3, "else_"), ["space", "cluster"], "left")
    none = F.array().cast("array<string>")
    # The sentences' wording.
    noise = F.concat(name, F.lit(" ist hier aktuell Noise. Es gibt lokale Ähnlichkeiten, aber keine dichte oder stabile Einbettung in einen Cluster."))
    placed = F.concat(name, F.lit(" liegt in "), F.coalesce("label", F.lit("einem Cluster")), F.lit(" mit "), F.coalesce("size", F.lit(0)).cast("string"), F.lit(" Mitgliedern. Die Zuordnung wird vor allem durch die typischen Cluster-Signaturen und die stärksten Nachbarverbindungen getragen."))
    unknown = F.concat(F.lit("Für "), name, F.lit(" liegt in diesem Raum noch keine belastbare Einordnung vor."))
    why_not = F.array(F.lit("zu wenig starker Mehrfach-Support zu anderen Lösungen"), F.lit("Ähnlichkeit verteilt sich eher punktuell als als dichter Block"))
    state = F.col("is_noise")
    pick = lambda a, b, c: F.when(state.isNull(), a).when(state, b).otherwise(c)
    return df.select("space", "sid", pick(unknown, noise, placed).alias("summary"), pick(none, F.coalesce("neighbor_story", none), F.coalesce("neighbor_story", none)).alias("neighbor_story"),
                     pick(none, none, F.coalesce("here", none)).alias("why_here"), pick(none, why_not, F.coalesce("else_", none)).alias("why_not_else"))


def describe_features(features: DataFrame) -> DataFrame:
    return features.select("feature", feature_family(F.col("feature")).alias("family"), humanize_feature(F.col("feature")).alias("label"))
