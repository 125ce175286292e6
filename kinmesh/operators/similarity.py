"""Pair similarity over sparse weighted vectors, calibration, statistics and fusion.

Dot products and minima come from one equi join on (space, feature). Pairs without a common
feature still get a row, from a spine of the sids of a space; all sums over single vectors
are aggregated once and joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.features import clip, safe_ratio

#: Blend of profile, contrast, overlap, size and rare overlap by space.
BLEND = {
    "expr": (0.22, 0.10, 0.24, 0.06, 0.38),
    "struct": (0.20, 0.14, 0.24, 0.06, 0.36),
    "sem": (0.24, 0.16, 0.34, 0.08, 0.18),
}
#: Base weights of the fused spaces.
FUSION_BASE = {"expr": 0.34, "struct": 0.38, "sem": 0.28}
RARE_LIMIT = 14


def rare_signals(weighted: DataFrame, limit: int = RARE_LIMIT) -> DataFrame:
    """(space, sid, feature, w, kind, has): the ``limit`` largest positive weights of each sid, once among its keys with a
    colon (kind structured) and once among all (kind any); ``has`` says whether the sid has a key with a colon."""
    marked = weighted.filter(F.col("w") > 0).withColumn("colon", F.col("feature").contains(":"))
    order = (F.desc("w"), F.col("feature"))
    own = F.row_number().over(Window.partitionBy("space", "sid", "colon").orderBy(*order))
    every = F.row_number().over(Window.partitionBy("space", "sid").orderBy(*order))
    has = F.max("colon").over(Window.partitionBy("space", "sid"))
    ranked = marked.withColumns({"own": own, "every": every, "has": has})
    kinds = F.array_compact(F.array(F.when(F.col("colon") & (F.col("own") <= limit), "structured"), F.when(F.col("every") <= limit, "any")))
    return ranked.select("space", "sid", "feature", "w", "has", F.explode(kinds).alias("kind"))


def rare_overlaps(weighted: DataFrame, limit: int = RARE_LIMIT) -> DataFrame:
    """(space, i, j, rare_overlap): minima over maxima of the common ones among both sids' rare signals.

    Signals are keys with a colon where both sids have some, else all keys of both. Pairs
    without a common signal have no row.
    """
    top = rare_signals(weighted, limit)
    a = top.withColumnsRenamed({"sid": "i", "w": "wi", "has": "has_i"})
    b = top.withColumnsRenamed({"sid": "j", "w": "wj", "has": "has_j"})
    met = a.join(b, ["space", "feature", "kind"]).filter((F.col("i") < F.col("j")) & ((F.col("kind") == "structured") == (F.col("has_i") & F.col("has_j"))))
    return met.groupBy("space", "i", "j").agg(safe_ratio(F.sum(F.least("wi", "wj")), F.sum(F.greatest("wi", "wj"))).alias("rare_overlap"))


def inverse_variance() -> Column:
    return F.when(F.col("std") >= 1e-9, 1 / (F.col("std") * F.col("std"))).otherwise(0.0)


def pair_components(weighted: DataFrame) -> DataFrame:
    """(space, i, j, profile, contrast, overlap, size, rare_overlap) for all i < j of a space.

    By a join on features, for spaces of few sids; :mod:`kinmesh.operators.blocked` has the same in blocks.
    """
    side = weighted.select("space", "feature", "sid", "w", inverse_variance().alias("v"))
    left, right = side.withColumnsRenamed({"sid": "i", "w": "wi"}), side.select("space", "feature", F.col("sid").alias("j"), F.col("w").alias("wj"))
    met = left.join(right, ["space", "feature"]).filter(F.col("i") < F.col("j"))
    met = met.groupBy("space", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("dot"), F.sum(F.col("wi") * F.col("wj") * F.col("v")).alias("dotv"), F.sum(F.least("wi", "wj")).alias("low"))
    ids = weighted.select("space", "sid").distinct()
    spine = ids.withColumnRenamed("sid", "i").join(ids.withColumnRenamed("sid", "j"), "space").filter(F.col("i") < F.col("j"))
    met = spine.join(met, ["space", "i", "j"], "left").fillna(0.0, ["dot", "dotv", "low"])
    return assemble_components(weighted, met, rare_overlaps(weighted))


def vector_sums(weighted: DataFrame) -> DataFrame:
    """(space, sid, ww, mass, wwv, wmv, mmv): what the components need of single vectors; mmv is the same for a space."""
    inv = inverse_variance()
    own = weighted.groupBy("space", "sid").agg(
        F.sum(F.col("w") * F.col("w")).alias("ww"),
        F.sum("w").alias("mass"),
        F.sum(F.col("w") * F.col("w") * inv).alias("wwv"),
        F.sum(F.col("w") * F.col("mean") * inv).alias("wmv"),
    )
    const = weighted.select("space", "feature", "mean", "std").distinct().groupBy("space").agg(F.sum(F.col("mean") * F.col("mean") * inv).alias("mmv"))
    return own.join(const, "space")


def assemble_components(weighted: DataFrame, met: DataFrame, rare: DataFrame) -> DataFrame:
    """The five components from the sums of all pairs, ``met`` (space, i, j, dot, dotv, low), and the rare overlaps of those that have one."""
    own = vector_sums(weighted)
    a = own.select("space", F.col("sid").alias("i"), *[F.col(c).alias(f"{c}_i") for c in ("ww", "mass", "wwv", "wmv")], "mmv")
    b = own.select("space", F.col("sid").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("ww", "mass", "wwv", "wmv")])
    return components(met.join(a, ["space", "i"]).join(b, ["space", "j"]).join(rare, ["space", "i", "j"], "left"))


def components(df: DataFrame) -> DataFrame:
    """The five components of pairs (space, i, j, dot, dotv, low, rare_overlap, mmv) with the sums of both sids as ww_i, ww_j and so on.

    The z-score dot product is expanded over w, so that only its first term needs the pair.
    """
    df = df.fillna(0.0, ["rare_overlap"])
    profile = clip(safe_ratio(F.col("dot"), F.sqrt("ww_i") * F.sqrt("ww_j")))
    zz = F.col("dotv") - F.col("wmv_i") - F.col("wmv_j") + F.col("mmv")
    zi, zj = F.col("wwv_i") - 2 * F.col("wmv_i") + F.col("mmv"), F.col("wwv_j") - 2 * F.col("wmv_j") + F.col("mmv")
    none = (zi <= 1e-12) & (zj <= 1e-12)
    zcos = F.when((zi <= 1e-12) | (zj <= 1e-12), 0.0).otherwise(zz / (F.sqrt(F.greatest(zi, F.lit(1e-12))) * F.sqrt(F.greatest(zj, F.lit(1e-12)))))
    contrast = F.when(none, profile).otherwise(clip((zcos + 1) / 2))
    mi, mj = F.col("mass_i"), F.col("mass_j")
    size = F.when((mi == 0) & (mj == 0), 1.0).otherwise(safe_ratio(F.least(mi, mj), F.greatest(mi, mj)))
    return df.select("space", "i", "j", profile.alias("profile"), contrast.alias("contrast"), safe_ratio(F.col("low"), mi + mj - F.col("low")).alias("overlap"), size.alias("size"), "rare_overlap")


def hybrid(components: DataFrame) -> DataFrame:
    """(space, i, j, raw): the space's blend of the five components, rounded to 6."""
    names = ("profile", "contrast", "overlap", "size", "rare_overlap")
    raw = F.lit(None).cast("double")
    for space, weights in BLEND.items():
        raw = F.when(F.col("space") == space, reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for w, c in zip(weights, names, strict=True)])).otherwise(raw)
    return components.select("space", "i", "j", F.round(raw, 6).alias("raw"))


def calibrate(pairs: DataFrame) -> DataFrame:
    """``pairs`` with cal: raw between the space's 10 and 90 % quantiles, clipped, rounded to 6.

    Quantiles too close fall back to the extremes, and then to raw itself.
    """
    q = pairs.groupBy("space").agg(F.percentile("raw", 0.1).alias("lo"), F.percentile("raw", 0.9).alias("hi"), F.min("raw").alias("mn"), F.max("raw").alias("mx"))
    flat = F.col("hi") - F.col("lo") < 1e-9
    q = q.select("space", F.when(flat, F.col("mn")).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("mx")).otherwise(F.col("hi")).alias("hi"))
    cal = F.when(F.col("hi") - F.col("lo") < 1e-9, F.col("raw")).otherwise(clip(F.try_divide(F.col("raw") - F.col("lo"), F.col("hi") - F.col("lo"))))
    return pairs.join(F.broadcast(q), "space").withColumn("cal", F.round(cal, 6)).drop("lo", "hi")


def similarity_stats(pairs: DataFrame, value: str = "cal") -> DataFrame:
    v = F.col(value)
    return pairs.groupBy("space").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        *[F.percentile(v, q / 100).alias(f"p{q}") for q in (10, 25, 50, 75, 90)],
    )


def histogram(pairs: DataFrame, value: str = "cal", bins: int = 8) -> DataFrame:
    """(space, bin, n): equal bins of [0, 1], the last closed, empty ones kept."""
    v = F.col(value)
    inside = pairs.filter(v.between(0, 1)).select("space", F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    frame = pairs.select("space").distinct().select("space", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(inside.groupBy("space", "bin").agg(F.count(F.lit(1)).alias("n")), ["space", "bin"], "left").fillna(0, ["n"])


def wide(pairs: DataFrame, value: str) -> DataFrame:
    """One row a pair with a column for each fused space; pairs lacking a space are left out."""
    picks = [F.max(F.when(F.col("space") == s, F.col(value))).alias(s) for s in FUSION_BASE]
    return pairs.filter(F.col("space").isin(*FUSION_BASE)).groupBy("i", "j").agg(*picks).dropna()


def pearson(x: str, y: str) -> Column:
    """Correlation from sums; 0 where a side has no variance; clipped."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    value = F.when((vx > 1e-12) & (vy > 1e-12), F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def space_profile(pairs: DataFrame) -> DataFrame:
    """One row: correlations of the spaces, and for each its uniqueness u_, sharpness h_, threshold t_ and weight w_."""
    spaces = list(FUSION_BASE)
    raw = wide(pairs, "raw")
    corr = raw.agg(*[F.round(pearson(a, b), 6).alias(f"c_{a}_{b}") for k, a in enumerate(spaces) for b in spaces[k + 1 :]], *[F.stddev_pop(s).alias(f"s_{s}") for s in spaces])
    cals = wide(pairs, "cal").agg(*[F.percentile(s, 0.72).alias(f"q_{s}") for s in spaces])
    row = corr.crossJoin(F.broadcast(cals))  # one row each
    for s in spaces:
        with_others = [f"c_{a}_{b}" for k, a in enumerate(spaces) for b in spaces[k + 1 :] if s in (a, b)]
        positive = [F.greatest(F.lit(0.0), F.col(c)) for c in with_others]
        row = row.withColumn(f"u_{s}", 1 - (positive[0] + positive[1]) / 2)
        row = row.withColumn(f"h_{s}", F.least(F.lit(1.45), F.greatest(F.lit(0.75), 0.75 + F.col(f"s_{s}") / 0.18)))
        row = row.withColumn(f"t_{s}", F.greatest(F.lit(0.58), F.col(f"q_{s}")))
        row = row.withColumn(f"x_{s}", F.lit(FUSION_BASE[s]) * (0.5 + 0.5 * F.col(f"u_{s}")) * F.col(f"h_{s}"))
    total = reduce(lambda a, b: a + b, [F.col(f"x_{s}") for s in spaces])
    return row.withColumns({f"w_{s}": F.when(total > 0, F.col(f"x_{s}") / total).otherwise(1 / 3) for s in spaces}).drop(*[f"{p}_{s}" for p in "sqx" for s in spaces])


def fused_representations(weighted: DataFrame, profile: DataFrame, limit: int = 12) -> DataFrame:
    """(sid, rank, feature, w, share): the ``limit`` largest dimensions of each sid over the fused spaces, under ``space|feature``.

    A weight counts with its space's weight times 0.55 + 0.45 of the space's uniqueness.
    ``profile`` is the one row of :func:`space_profile`.
    """
    discount = F.lit(0.0)
    for s in FUSION_BASE:
        discount = F.when(F.col("space") == s, F.col(f"w_{s}") * (0.55 + 0.45 * F.col(f"u_{s}"))).otherwise(discount)
    own = weighted.filter(F.col("space").isin(*FUSION_BASE) & (F.abs("w") >= 1e-9)).crossJoin(F.broadcast(profile))  # one row
    own = own.select("sid", F.concat_ws("|", "space", "feature").alias("feature"), (discount * F.col("w")).alias("w"))
    by = Window.partitionBy("sid")
    ranked = own.withColumn("share", F.abs("w") / F.sum(F.abs("w")).over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.abs("w").desc(), F.col("feature").desc())))
    return ranked.filter(F.col("rank") <= limit).select("sid", "rank", "feature", "w", "share")


def fuse(pairs: DataFrame) -> DataFrame:
    """(space 'fusion', i, j, raw, cal, mean, agreement, n_support) over calibrated pairs of the three spaces."""
    spaces = list(FUSION_BASE)
    df = wide(pairs, "cal").crossJoin(F.broadcast(space_profile(pairs)))  # one row
    total = lambda f: reduce(lambda a, b: a + b, [f(s) for s in spaces])
    flag = lambda s: (F.col(s) >= F.col(f"t_{s}")).cast("double")
    df = df.withColumn("mean", total(lambda s: F.col(f"w_{s}") * F.col(s)))
    df = df.withColumn("agreement", F.greatest(F.lit(0.0), 1 - F.sqrt(total(lambda s: F.col(f"w_{s}") * (F.col(s) - F.col("mean")) * (F.col(s) - F.col("mean"))))))
    df = df.withColumn("n_support", total(flag)).withColumn("sw", total(lambda s: flag(s) * F.col(f"w_{s}")))
    share = lambda s: F.col(f"w_{s}") * F.greatest(F.lit(0.05), F.col(f"u_{s}"))
    df = df.withColumn("ind", total(lambda s: flag(s) * share(s)) / F.greatest(F.lit(1e-9), total(share)))
    reliance = F.greatest(*[F.col(f"w_{s}") * F.col(s) for s in spaces]) / F.greatest(F.lit(1e-9), F.col("mean"))
    penalty = F.when(F.col("n_support") < 2, F.greatest(F.lit(0.0), reliance - 0.72)).otherwise(0.0)
    bonus = F.when(F.col("n_support") == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.55 * F.col("sw") + 0.45 * F.col("n_support") / 3))
    score = clip(0.60 * F.col("mean") + 0.14 * F.col("agreement") + 0.14 * bonus + 0.08 * F.col("ind") + 0.04 * F.col("n_support") / 3 - 0.10 * penalty)
    out = df.select(F.lit("fusion").alias("space"), "i", "j", F.round(score, 6).alias("raw"), "mean", "agreement", F.col("n_support").cast("int").alias("n_support"))
    return calibrate(out)
