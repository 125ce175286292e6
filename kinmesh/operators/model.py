"""From long feature tables to the corpus model.

L is a table (space, sid, feature, value); a missing feature is 0. All spaces go through
one plan, keyed by ``space``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.features import feature_kind, feature_scale, transform_value


def aggregate_features(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Files (space, sid, file_id, feature, value) to L: counts add up, ratios average over the files that have them, binaries take any.

    ``file_count`` is added for each space and sid. It is counted over ``listed`` (space, sid, file_id), the files that
    have features, where that is known without them, as ``files`` would be made a second time for it.
    """
    kind = feature_kind(F.col("feature"))
    summed = files.groupBy("space", "sid", "feature").agg(F.sum("value").alias("s"), F.avg("value").alias("m"), F.max("value").alias("x"))
    value = F.when(kind == "binary", (F.col("x") > 0).cast("double")).when(kind == "ratio", F.col("m")).otherwise(F.col("s"))
    counted = (files if listed is None else listed).groupBy("space", "sid").agg(F.countDistinct("file_id").cast("double").alias("value")).select("space", "sid", F.lit("file_count").alias("feature"), "value")
    return summed.select("space", "sid", "feature", value.alias("value")).unionByName(counted)


def feature_stats(long: DataFrame) -> DataFrame:
    """(space, feature, df, n, sparsity, weight, mean, std) of the weighted values, zeros of absent features included.

    One aggregate on (space, feature); the number of sids of a space comes from a second small
    one. Absent values need no rows, since they add nothing to the sums.
    """
    n = long.groupBy("space").agg(F.countDistinct("sid").alias("n"))
    t = transform_value(feature_kind(F.col("feature")), F.col("value"))
    seen = long.withColumn("t", t).groupBy("space", "feature").agg(F.count_if(F.abs("t") > 1e-9).alias("df"), F.sum("t").alias("s1"), F.sum(F.col("t") * F.col("t")).alias("s2"))
    df, total = F.col("df"), F.col("n")
    sparsity = 1 - df / total
    idf = F.log((1 + total) / (1 + df)) + 1
    rare = (feature_kind(F.col("feature")) == "binary") | (sparsity >= 0.4) | F.col("feature").rlike("^ast_(node|edge|path):")
    weight = F.when(rare, idf).otherwise(1.0) * feature_scale(F.col("space"), F.col("feature"))
    out = seen.join(n, "space").withColumn("sparsity", sparsity).withColumn("weight", weight)
    mean = F.col("weight") * F.col("s1") / total
    spread = F.col("weight") * F.col("weight") * F.col("s2") / total - mean * mean
    return out.select("space", "feature", "df", "n", "sparsity", "weight", mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"))


def weighted_features(long: DataFrame, stats: DataFrame) -> DataFrame:
    """L with w = transformed value times weight, and z = (w - mean) / std (0 for std below 1e-9)."""
    t = transform_value(feature_kind(F.col("feature")), F.col("value"))
    out = long.join(stats, ["space", "feature"]).withColumn("w", t * F.col("weight"))
    return out.withColumn("z", F.when(F.col("std") < 1e-9, 0.0).otherwise((F.col("w") - F.col("mean")) / F.col("std")))


def top_dimensions(weighted: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` features of largest absolute weight of each sid with their share of all; names break ties downward."""
    by = Window.partitionBy("space", "sid")
    ranked = weighted.withColumn("share", F.abs("w") / F.sum(F.abs("w")).over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.abs("w").desc(), F.col("feature").desc())))
    return ranked.filter(F.col("rank") <= limit).select("space", "sid", "rank", "feature", "w", "share")
