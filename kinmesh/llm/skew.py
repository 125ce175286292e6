"""A join whose hot keys are dealt into shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.session import own_name

#: A key is hot with more than ROWS rows and more than one row in SHARES, so at most SHARES keys are; that bounds what is broadcast.
SHARES, ROWS = 10_000, 1024


def dealt_join(left: DataFrame, right: DataFrame, key: str, tie: Column, rows: int = ROWS) -> DataFrame:
    """Inner join on ``key`` in which the left rows of a hot key go to several tasks, by a hash of ``tie``.

    The right rows of a hot key are copied to each of its shares. Rows with a null key meet nothing.
    """
    share = own_name(right, own_name(left, "share"))
    n = own_name(right, own_name(left, "shares"))
    least = max(rows, left.count() // SHARES)
    hot = left.groupBy(key).count().filter(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias(n))
    a = left.join(F.broadcast(hot), key, "left").withColumn(share, F.coalesce(F.pmod(F.xxhash64(tie), F.col(n)).cast("int"), F.lit(0))).drop(n)
    b = right.join(F.broadcast(hot), key, "left").withColumn(share, F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))).drop(n)
    return a.join(b, [key, share]).drop(share)
