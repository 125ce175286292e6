"""A catalogue of runs and their artefacts, one table partitioned by assignment, run and artefact.

A reader names what it wants and the scan opens those folders alone. An artefact is a set of
JSON rows; each assignment, run and artefact has a folder of its own, replaced as a whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The artefacts of a drift run; all must be there but the optional ones.
ARTIFACTS = ("overview", "projection", "clusters", "year_stats", "year_similarity", "neighbors")
OPTIONAL = ("neighbors",)
SCHEMA = "row bigint, payload string, assignment string, run_id string, artifact string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The whole catalogue; empty where nothing was written."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{root}/artifacts")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def store_artifact(df: DataFrame, root: str, assignment: str, run_id: str, artifact: str) -> None:
    """Write a table as an artefact. Nulls are kept as fields, so that a reader sees every column; an empty table leaves an empty artefact."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))
    rows.write.mode("overwrite").parquet(f"{root}/artifacts/assignment={assignment}/run_id={run_id}/artifact={artifact}")


def store_run(tables: dict[str, DataFrame], root: str, assignment: str, run_id: str) -> None:
    for name, df in tables.items():
        store_artifact(df, root, assignment, run_id, name)


def present(spark: SparkSession, root: str, assignment: str, run_id: str) -> set[str]:
    """Artefacts of a run that are written in full, empty ones too; one listing of one folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/artifacts/assignment={assignment}/run_id={run_id}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return set()
    parts = [s.getPath() for s in system.listStatus(place) if s.isDirectory()]
    return {p.getName().removeprefix("artifact=") for p in parts if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def find_run(spark: SparkSession, root: str, run_id: str) -> str:
    """The assignment of a run; a run that is nowhere is an error. Only folder names are read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/artifacts/assignment=*/run_id={run_id}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    names = sorted(s.getPath().getParent().getName().removeprefix("assignment=") for s in found or ())
    if not names:
        raise FileNotFoundError(f"no run {run_id}")
    return names[0]


def run_artifacts(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """(row, payload) of each artefact of a run, in the order written. A missing one is an error, an optional one is empty."""
    assignment = find_run(spark, root, run_id)
    there = present(spark, root, assignment, run_id)
    missing = [a for a in ARTIFACTS if a not in there and a not in OPTIONAL]
    if missing:
        raise FileNotFoundError(f"run {run_id} lacks {', '.join(missing)}")
    own = scan(spark, root).filter((F.col("assignment") == assignment) & (F.col("run_id") == run_id))
    return {a: own.filter(F.col("artifact") == a).select("row", "payload").orderBy("row") for a in ARTIFACTS}


def complete_runs(spark: SparkSession, root: str, assignment: str | None = None) -> DataFrame:
    """(assignment, run_id, artifacts, missing, complete): what each run has; one assignment reads its own folders alone."""
    rows = scan(spark, root)
    if assignment is not None:
        rows = rows.filter(F.col("assignment") == assignment)
    held = rows.select("assignment", "run_id", "artifact").distinct().groupBy("assignment", "run_id").agg(F.sort_array(F.collect_set("artifact")).alias("artifacts"))
    needed = F.array(*[F.lit(a) for a in ARTIFACTS if a not in OPTIONAL])
    lacking = F.array_except(needed, "artifacts")
    return held.select("assignment", "run_id", "artifacts", lacking.alias("missing"), (F.size(lacking) == 0).alias("complete"))


def listed_bundles(bundles: DataFrame, manifests: DataFrame) -> DataFrame:
    """``bundles`` (assignment, bundle_id, year, created) with their manifest where there is one, and their place by year, then time."""
    place = F.row_number().over(Window.partitionBy("assignment").orderBy("year", "created", "bundle_id"))
    return bundles.join(manifests, "bundle_id", "left").withColumn("place", place)


def listed_assignments(bundles: DataFrame) -> DataFrame:
    """(assignment, updated, bundles, years, valid, place): the latest change first."""
    df = bundles.groupBy("assignment").agg(F.max("created").alias("updated"), F.count(F.lit(1)).alias("bundles"), F.sort_array(F.collect_set("year")).alias("years"), F.sum(F.coalesce("valid_zip_count", F.lit(0))).alias("valid"))
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated"), "assignment")))  # a row an assignment
