"""Sinks: pair chunks, publishing behind a gate, reading JSON with a default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kinmesh.operators.runs import upsert  # noqa: F401  the upsert of list tables

CHUNK = 5000


def write_pairs(pairs: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Pairs by space, in files of at most ``chunk`` rows; tasks write their own rows, without a shuffle or a count."""
    pairs.write.mode("overwrite").option("maxRecordsPerFile", chunk).partitionBy("space").parquet(path)


def write_artifacts(tables: dict[str, DataFrame], run_dir: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{run_dir}/{name}")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON with a fixed schema; an empty table where there is no file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def publish(spark: SparkSession, run_dir: str, required: tuple[str, ...], pointer: str, run_id: str) -> None:
    """Move the pointer to a run whose artefacts are all there; a missing one is an error and nothing moves.

    Each move adds a numbered version and deletes none, so a reader finds the last whole one at
    any time. Two writers that take one number collide on its folder, and one of them fails.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    missing = []
    for name in required:
        place = hadoop(f"{run_dir}/{name}/_SUCCESS")
        if not place.getFileSystem(conf).exists(place):
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"run {run_id} lacks {', '.join(missing)}")
    version = max(_versions(spark, pointer), default=0) + 1
    spark.createDataFrame([(run_id, run_dir)], "run_id string, run_dir string").coalesce(1).write.mode("error").parquet(f"{pointer}/version-{version:09d}")


def _versions(spark: SparkSession, pointer: str) -> list[int]:
    """Numbers of the versions that are written in full."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    made = [s.getPath() for s in system.listStatus(place) if s.isDirectory()]
    whole = [p.getName() for p in made if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [int(n.removeprefix("version-")) for n in whole if n.startswith("version-")]


def published(spark: SparkSession, pointer: str) -> str | None:
    """The run that the newest version names, None where there is none."""
    if not (versions := _versions(spark, pointer)):
        return None
    return spark.read.parquet(f"{pointer}/version-{max(versions):09d}").first()["run_id"]
