"""Session helpers: building a session, reading tables, and cutting lineage through shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, name: str) -> str:
    """A column name for internal use that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster master
    is an error, since its executors would not share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="kinmesh-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read back.

    The plan above it starts from files, so a lost executor costs a re-read and
    not a recomputation, and every consumer reads one computed copy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinmesh/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialize` returned."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
