"""Queries on run logs: the events table is the log, a user an assignment, an event type a status."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.operators import runs as R
from kinmesh.session import read_table


def latest_run(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return R.latest_runs(events, "user_id", created="ts", tie="event_id").select("user_id", "event_id", "event_type")


def run_event_tail(spark, sf_dir):
    tail = R.event_tail(read_table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return tail.select("user_id", "n", "event_id", "event_type")


def _cache_counters(spark, sf_dir, content):
    """Documents ask a cache that holds the vectors of ids divisible by 3; those divisible by 9 there are cut short, so stale."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model"), content.alias("t"))
    asked = docs.select("doc_id", "model", F.sha2("t", 256).alias("text_sha256"))
    held = asked.filter(F.col("doc_id") % 3 == 0).groupBy("model", "text_sha256").agg(F.min("doc_id").alias("d"))
    vector = F.when(F.col("d") % 9 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    cache = held.select("model", "text_sha256", F.lit(2).alias("dimension"), vector.alias("vector"))
    return R.cache_counters(R.cache_lookup(asked, cache))


def cache_counters(spark, sf_dir):
    """Counters by source and length, as its SQL states; equal whole texts are in cache_text_counters."""
    return _cache_counters(spark, sf_dir, F.concat(F.col("source"), F.lit(":"), F.col("n_chars").cast("string")))


def cache_text_counters(spark, sf_dir):
    """Counters by the digest of the whole text; a null text is empty."""
    return _cache_counters(spark, sf_dir, F.coalesce("text", F.lit("")))


SQL = {
    "latest_run": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "run_event_tail": "SELECT user_id, n, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 8",
    "cache_counters": """WITH a AS (SELECT doc_id, 'm' || (doc_id % 2) AS model, sha256(source || ':' || n_chars) AS h FROM documents),
  c AS (SELECT model, h, min(doc_id) AS d FROM a WHERE doc_id % 3 = 0 GROUP BY ALL)
  SELECT a.model, count(*) AS requests, count(*) FILTER (WHERE d IS NOT NULL AND d % 9 <> 0) AS hits, count(*) FILTER (WHERE d IS NULL) AS misses, count(*) FILTER (WHERE d % 9 = 0) AS stale, 0::BIGINT AS bypassed
  FROM a LEFT JOIN c ON a.model = c.model AND a.h = c.h GROUP BY ALL""",
}
SQL["cache_text_counters"] = SQL["cache_counters"].replace("sha256(source || ':' || n_chars)", "sha256(coalesce(text, ''))")
QUERIES = {name: globals()[name] for name in SQL}
