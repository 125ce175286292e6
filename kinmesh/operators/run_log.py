"""A run's log folded into its state, in parts that can be merged.

An event is (run, seq, at, kind, stage, message, current, total, error). The fold keeps, of
each field, the value of the last event that has one, so it is a maximum by place: parts of a
log may be folded anywhere, in any order, and merged, and a new part joins what is stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that a state shows, and the kinds of event that end a run.
SHOWN, ENDS = 8, {"published": "published", "failed": "failed"}
FIELDS = ("stage", "message", "current", "total", "error")


def partial_states(events: DataFrame, *part: str) -> DataFrame:
    """One row per run, and ``part``: the last value of each field with its place, the first and last event, states by stage.

    A stage is done once a later one began, running while it is the last, and failed if the run failed in it.
    """
    keys = ["run", *part]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("value")))).alias(c) for c in FIELDS]
    ended = F.max(F.when(F.col("kind").isin(*ENDS), F.struct("seq", F.col("kind").alias("value")))).alias("ended")
    spans = events.filter(F.col("stage").isNotNull()).groupBy(*keys, "stage").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    stages = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "last", "stage"))).alias("stages"))  # as many as there are stages
    shown = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    tail = events.withColumn("n", F.row_number().over(shown)).filter(F.col("n") <= SHOWN)
    tail = tail.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "stage", "message"))).alias("tail"))
    whole = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "at")).alias("began"), F.max(F.struct("seq", "at")).alias("heard"), ended, *last)
    return whole.join(stages, keys, "left").join(tail, keys, "left")


def merge_states(*parts: DataFrame) -> DataFrame:
    """One row per run from partial states, in any order; merging them in steps gives the same."""
    rows = reduce(DataFrame.unionByName, parts)
    spans = rows.select("run", F.explode("stages").alias("s")).groupBy("run", "s.stage").agg(F.min("s.first").alias("first"), F.max("s.last").alias("last"))
    stages = spans.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("first", "last", "stage"))).alias("stages"))
    shown = Window.partitionBy("run").orderBy(F.desc("e.seq"))
    tail = rows.select("run", F.explode("tail").alias("e")).withColumn("k", F.row_number().over(shown)).filter(F.col("k") <= SHOWN)
    tail = tail.groupBy("run").agg(F.sort_array(F.collect_list("e")).alias("tail"))
    whole = rows.groupBy("run").agg(F.sum("n").alias("n"), F.min("began").alias("began"), F.max("heard").alias("heard"), F.max("ended").alias("ended"), *[F.max(c).alias(c) for c in FIELDS])
    return whole.join(stages, "run", "left").join(tail, "run", "left")


def percent(current: Column, total: Column) -> Column:
    """Whole percent, round half to even; 0 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.bround(F.coalesce(current, F.lit(0)) / total * 100)).otherwise(0).cast("int")


def run_states(folded: DataFrame) -> DataFrame:
    """(run, status, stage, message, percent, events, began_at, heard_at, stages, tail, error) from merged states.

    Status is queued, running, published or failed; stages map each stage to done, running or failed.
    """
    value = lambda c: F.col(c)["value"]
    status = F.coalesce(value("ended"), F.when(F.coalesce(F.size("stages"), F.lit(0)) > 0, "running").otherwise("queued"))
    newest = F.array_max(F.transform("stages", lambda s: F.struct(s["last"], s["stage"])))["stage"]
    state = lambda s: F.when(s["stage"] != newest, "done").when(status == "failed", "failed").when(status == "published", "done").otherwise("running")
    stages = F.transform("stages", lambda s: F.struct(s["stage"].alias("stage"), state(s).alias("state")))
    return folded.select(
        "run", status.alias("status"), value("stage").alias("stage"), value("message").alias("message"), percent(value("current"), value("total")).alias("percent"), F.col("n").alias("events"),
        F.col("began.at").alias("began_at"), F.col("heard.at").alias("heard_at"), stages.alias("stages"), "tail", F.when(status == "failed", value("error")).alias("error"),
    )


def fold_log(events: DataFrame) -> DataFrame:
    return run_states(partial_states(events))
