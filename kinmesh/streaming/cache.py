"""The vector cache as a stream: a keyed state of what is held, and counters that outlive restarts.

A request asks for a (model, text_sha256). What it meets depends on what came before it under
its key: nothing (miss, then written), a valid vector (hit), a broken one (stale, then
written anew), or it asks to bypass (bypassed, written all the same). The state of a key is
whether its vector is valid; Spark keeps it in the state store and restores it from the
checkpoint. Each batch writes its own counters under its number, so one that is repeated
replaces itself, and totals are sums over the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests and, as seeds, entries that the cache holds at the start; ``seq`` orders the rows of a key.
REQUESTS = "seq bigint, model string, text_sha256 string, kind string, valid boolean"
STATES = ("hit", "miss", "stale", "bypassed")


def told(rows: pd.DataFrame, valid: bool | None) -> tuple[dict[str, int], bool | None]:
    """Counters of the rows of a key in order, and whether its vector is valid after them (None: not held)."""
    counts = dict.fromkeys(STATES, 0)
    for kind, seeded in rows.sort_values("seq")[["kind", "valid"]].itertuples(index=False):
        if kind == "seed":
            valid = bool(seeded)
            continue
        counts["bypassed" if kind == "force" else "miss" if valid is None else "hit" if valid else "stale"] += 1
        valid = True  # every request leaves a vector behind
    return counts, valid


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts))
    counts, valid = told(rows, state.get[0] if state.exists else None)
    if valid is not None:
        state.update((valid,))
    yield pd.DataFrame([(key[0], sum(counts.values()), *counts.values())], columns=["model", "requests", *STATES])


def cache_stream(requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take all requests (columns of REQUESTS) that have arrived and stop; run again, it goes on from its state.

    A key's rows in a batch are read in the order of ``seq``; those of a later batch come after them.
    """
    schema = "model string, requests bigint, " + ", ".join(f"{s} bigint" for s in STATES)
    counted = requests.groupBy("model", "text_sha256").applyInPandasWithState(_update, schema, "valid boolean", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("requests", *STATES)])
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_totals(spark: SparkSession, out: str) -> DataFrame:
    """(model, requests, hit, miss, stale, bypassed) over all batches written."""
    return spark.read.parquet(out).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("requests", *STATES)])


def replayed_counters(requests: DataFrame) -> DataFrame:
    """The same totals from a table at once: a request meets what the last row before it under its key left.

    The window goes by key; a hot text is one key and its rows are read in order, as the
    stream reads them.
    """
    before = Window.partitionBy("model", "text_sha256").orderBy("seq")
    held = F.lag(F.when(F.col("kind") == "seed", F.col("valid")).otherwise(F.lit(True))).over(before)
    state = F.when(F.col("kind") == "force", "bypassed").when(held.isNull(), "miss").when(held, "hit").otherwise("stale")
    rows = requests.withColumn("state", state).filter("kind <> 'seed'")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
