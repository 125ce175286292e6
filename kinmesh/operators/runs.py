"""Run logs, publishing and the content-addressed cache as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.session import own_name


def latest_runs(runs: DataFrame, *keys: str, created: str = "created_at", tie: str = "run_id") -> DataFrame:
    """The newest run of each key; ``tie`` decides between equal times, the larger wins.

    A maximum of structs is a partial aggregate, so a key with most of the runs is no hot spot.
    """
    best = runs.groupBy(*keys).agg(F.max(F.struct(F.col(created), F.col(tie), F.struct(*[c for c in runs.columns if c not in keys]).alias("r"))).alias("m"))
    return best.select(*keys, "m.r.*")


def event_tail(events: DataFrame, key: str, at: str, tie: str, last: int = 8) -> DataFrame:
    """The last events of each key in order; n is the place from the end. Window group limits prune before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return events.withColumn("n", rank).filter(F.col("n") <= last)


def cache_lookup(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Requests (model, text_sha256) with vector and state: hit, miss, stale or bypassed.

    A cached entry is valid if its vector has the stated dimension and finite values. ``force``
    bypasses reading. One row an entry; the cache holds one row a (model, text_sha256).
    """
    v = F.col("vector")
    valid = v.isNotNull() & (F.size(v) > 0) & (F.size(v) == F.col("dimension")) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    state = F.when(F.lit(force), "bypassed").when(F.col("dimension").isNull() & v.isNull(), "miss").when(F.coalesce(valid, F.lit(False)), "hit").otherwise("stale")
    df = requests.join(cache.select("model", "text_sha256", "dimension", "vector"), ["model", "text_sha256"], "left").withColumn("state", state)
    return df.withColumn("vector", F.when(F.col("state") == "hit", v))


def cache_counters(looked_up: DataFrame) -> DataFrame:
    return looked_up.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("state") == s).alias(name) for s, name in (("hit", "hits"), ("miss", "misses"), ("stale", "stale"), ("bypassed", "bypassed"))])


def cache_missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (model, text_sha256) still to be computed; later repeats within the run then hit."""
    return requests.select("model", "text_sha256").distinct().join(cache, ["model", "text_sha256"], "left_anti")


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``table`` with the rows of equal keys replaced by ``rows``."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def eligible_assignments(bundles: DataFrame) -> DataFrame:
    """(assignment, years, valid, eligible, reason): at least two years and one valid archive."""
    df = bundles.groupBy("assignment").agg(F.array_sort(F.collect_set("year")).alias("years"), F.sum("valid_zip_count").alias("valid"))
    reason = F.when(F.col("valid") <= 0, "no_valid_zip").when(F.size("years") < 2, "needs_two_years")
    return df.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def unique_ids(rows: DataFrame, candidate: str, *order: str) -> DataFrame:
    """``rows`` with submission_id: the candidate, with _2, _3, ... for repeats in ``order``.

    A number is passed over where some row's candidate already reads like the result, so ids
    stay distinct: a repeat takes the n-th number that no candidate has taken.
    """
    name = own_name(rows, "nth")
    nth = F.row_number().over(Window.partitionBy(candidate).orderBy(*order))
    tail = F.regexp_extract(candidate, r"^(.+)_([1-9][0-9]*)$", 2)
    taken = rows.filter(tail != "").select(F.regexp_extract(candidate, r"^(.+)_([1-9][0-9]*)$", 1).alias(candidate), F.try_to_number(tail, F.lit("999999999")).cast("bigint").alias("k")).distinct()
    taken = taken.groupBy(candidate).agg(F.sort_array(F.collect_set("k")).alias(f"{name}_taken"))  # as many as there are ids with that stem
    df = rows.withColumn(name, nth).join(taken, candidate, "left")
    free = F.aggregate(F.coalesce(f"{name}_taken", F.array().cast("array<bigint>")), F.col(name).cast("bigint"), lambda n, k: F.when((k >= 2) & (k <= n), n + 1).otherwise(n))
    made = F.when(F.col(name) > 1, F.concat(F.col(candidate), F.lit("_"), free.cast("string"))).otherwise(F.col(candidate))
    return df.withColumn("submission_id", made).select(*rows.columns, "submission_id")


def submission_id(year, bundle, archive_hash, path, index):
    """sub_{year}_{12 digits of the archive hash}_{8 digits of the place's hash}."""
    place = F.sha2(F.concat_ws(":", bundle, path, index.cast("string")), 256)
    return F.concat(F.lit("sub_"), year.cast("string"), F.lit("_"), F.substring(archive_hash, 1, 12), F.lit("_"), F.substring(place, 1, 8))
