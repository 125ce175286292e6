"""Arrival of bundles as a stream of files: each batch is classified and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.sources.archives import classify_bundle


def bundle_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("bundle"), "content")


def classify_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Start a query that classifies all bundles that have arrived and stops; run again, it takes only new ones.

    A batch is written under its own number, so one that is repeated after a failure replaces itself.
    """

    def append(batch: DataFrame, number: int) -> None:
        classify_bundle(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bundle_stream(spark, path).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
