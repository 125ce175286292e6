"""A store of bundles: content-addressed ingest with reuse, deletion, and invalidation of runs.

Tables under one root, all Parquet:

events       (assignment, seq, kind, bundle_id, year, filename, sha256, size_bytes): imports and deletions, appended, never changed
files        (bundle_id | archive_hash, index, relative_path, sha256, size_bytes, recovered, six normal forms), once for each archive content
archives     (bundle_id | archive_hash, status, files, relevant, ignored, recovered, error): written after ``files``, so an archive named here is whole
submissions  (bundle_id | assignment, year, submission_id, name, archive_path, archive_hash): one row for each archive of a bundle
runs         (assignment | run_id, version, created): a run keeps the version of its assignment that it read

An archive's content belongs to the bundle that brought it first (its partition). Writes
replace whole partitions of the bundles at hand, with what they held before, so an ingest
that was killed and is run again ends in the same tables. An assignment's version is the
number of its events: an import or a deletion makes all earlier runs stale.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.functions.text import normalizations, strip_comments
from kinmesh.operators.runs import submission_id, unique_ids
from kinmesh.session import materialize
from kinmesh.sources.archives import entries, relevant_source, submission_archives

EVENTS = "assignment string, seq bigint, kind string, bundle_id string, year int, filename string, sha256 string, size_bytes bigint"
FILES = "archive_hash string, index int, relative_path string, sha256 string, size_bytes bigint, recovered boolean, forms struct<raw:string,whitespace:string,no_comments:string,masked_identifiers:string,masked_literals:string,ast_normalized:string>, bundle_id string"
ARCHIVES = "archive_hash string, status string, files bigint, relevant bigint, ignored bigint, recovered bigint, error string, bundle_id string"
SUBMISSIONS = "assignment string, year int, submission_id string, name string, archive_path string, archive_hash string, bundle_id string"
RUNS = "run_id string, version bigint, created timestamp, assignment string"
SCHEMAS = {"events": EVENTS, "files": FILES, "archives": ARCHIVES, "submissions": SUBMISSIONS, "runs": RUNS}
#: Years that an import may have, and what an assignment's key may look like.
YEARS, KEY = (1900, 2200), r"^[A-Za-z0-9_.-]{1,120}$"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the store; empty where nothing was written yet."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS[name])


def replace_partitions(df: DataFrame, root: str, name: str, by: str) -> None:
    """Write ``df`` over the partitions that it has rows of, and leave all others. It is written aside first, as it may come from them."""
    held = materialize(df, name)
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{name}")


def live_bundles(spark: SparkSession, root: str) -> DataFrame:
    """(assignment, bundle_id, year, filename, sha256, size_bytes, version): imports without a later deletion."""
    events = table(spark, root, "events")
    version = events.groupBy("assignment").agg(F.max("seq").alias("version"))
    gone = events.filter("kind = 'delete'").select("assignment", "bundle_id").distinct()
    return events.filter("kind = 'import'").join(gone, ["assignment", "bundle_id"], "left_anti").join(version, "assignment").drop("seq", "kind")


def append_event(spark: SparkSession, root: str, **event) -> int:
    """Add an event under the next number of its assignment and return it; two writers of one number collide, and one fails."""
    last = table(spark, root, "events").filter(F.col("assignment") == event["assignment"]).agg(F.max("seq")).first()[0] or 0
    row = {"year": None, "filename": None, "sha256": None, "size_bytes": None} | event | {"seq": last + 1}
    names = [f.split()[0] for f in EVENTS.split(", ")]
    one = spark.createDataFrame([tuple(row[n] for n in names)], EVENTS)
    one.coalesce(1).write.mode("error").parquet(f"{root}/events/event={event['assignment']}-{last + 1:09d}")
    return last + 1


def import_bundle(spark: SparkSession, root: str, assignment: str, year: int, bundle_id: str, content: DataFrame) -> int:
    """Check key and year, ingest the bundle's one row of ``content`` (bundle, content), and log the import; earlier runs are stale then.

    The event is last, so a bundle that is named is whole. A bundle without a readable archive
    is an error, as is one that cannot be opened.
    """
    import re

    if not re.match(KEY, assignment) or not re.match(KEY, bundle_id):
        raise ValueError(f"no key of an assignment or bundle: {assignment}, {bundle_id}")
    if not YEARS[0] <= year <= YEARS[1]:
        raise ValueError(f"no plausible year: {year}")
    ingest(spark, root, content.withColumns({"bundle_id": F.lit(bundle_id), "assignment": F.lit(assignment), "year": F.lit(year)}))
    told = content.select("bundle", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size")).first()
    if told is None:
        raise ValueError(f"bundle {bundle_id} has no content")
    return append_event(spark, root, assignment=assignment, kind="import", bundle_id=bundle_id, year=year, filename=told["bundle"], sha256=told["sha256"], size_bytes=told["size"])


def unpacked(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, states) of archives (archive_hash, content), each hash once; one that cannot be read has status error and no files.

    A file whose bytes are no UTF-8 is recovered: malformed parts are replaced.
    """
    listed = materialize(entries(archives, "archive_hash", wanted=lambda path: path.lower().endswith(".java")), "entries")
    own = listed.filter(~F.col("corrupt") & relevant_source(F.col("path")))
    text = F.make_valid_utf8(F.col("data").cast("string"))
    parts = own.withColumns({"text": text, "recovered": ~F.is_valid_utf8(F.col("data").cast("string"))}).withColumn("bare", strip_comments(F.col("text"))["text"])
    forms = normalizations(F.col("text"), F.col("bare"))
    files = parts.select("archive_hash", "index", F.col("path").alias("relative_path"), F.sha2("data", 256).alias("sha256"), F.length("data").cast("bigint").alias("size_bytes"), "recovered", F.struct(*[c.alias(n) for n, c in forms.items()]).alias("forms"))
    bad = F.coalesce(~F.is_valid_utf8(F.col("data").cast("string")), F.lit(False))
    keep = F.coalesce(relevant_source(F.col("path")), F.lit(False))
    stats = listed.groupBy("archive_hash").agg(F.bool_or("corrupt").alias("corrupt"), F.count("path").alias("files"), F.count_if(keep).alias("relevant"), F.count_if(keep & bad).alias("recovered"))
    stats = archives.select("archive_hash").join(stats, "archive_hash", "left").fillna({"corrupt": False, "files": 0, "relevant": 0, "recovered": 0})
    status = F.when(F.col("corrupt"), "error").when(F.col("relevant") == 0, "empty").otherwise("ok")
    states = stats.select("archive_hash", status.alias("status"), "files", "relevant", (F.col("files") - F.col("relevant")).alias("ignored"), "recovered", F.when(F.col("corrupt"), "no readable ZIP archive").alias("error"))
    return files, states


def ingest(spark: SparkSession, root: str, bundles: DataFrame) -> int:
    """Store the archives of ``bundles`` (bundle_id, assignment, year, content); returns how many had to be unpacked.

    An archive whose content is stored already, by whatever bundle, is not opened again: the
    new ones are those whose hash ``archives`` does not name. Order of writing: files, their
    states, then the submissions.
    """
    found = submission_archives(bundles.select(F.col("bundle_id").alias("bundle"), "content"))
    found = materialize(found.withColumnRenamed("bundle", "bundle_id").withColumn("archive_hash", F.sha2("content", 256)), "found")
    known = table(spark, root, "archives")
    new = found.join(known.select("archive_hash"), "archive_hash", "left_anti")
    new = materialize(new.groupBy("archive_hash").agg(F.min_by(F.struct("bundle_id", "content"), F.struct("bundle_id", "index")).alias("s")).select("archive_hash", "s.*"), "new")
    n = new.count()
    if n:
        owner = new.select("archive_hash", "bundle_id")
        files, states = unpacked(new)
        for name, rows in (("files", files), ("archives", states)):
            mine = rows.join(owner, "archive_hash")
            before = table(spark, root, name).join(owner.select("bundle_id").distinct(), "bundle_id").join(owner.select("archive_hash"), "archive_hash", "left_anti")
            replace_partitions(mine.select(before.columns).unionByName(before), root, name, "bundle_id")
    told = found.join(bundles.select("bundle_id", "assignment", "year"), "bundle_id")
    made = told.withColumn("base", submission_id(F.col("year"), F.col("bundle_id"), F.col("archive_hash"), F.col("archive_path"), F.col("index")))
    named = unique_ids(made.drop("content"), "base", "bundle_id", "index")
    replace_partitions(named.select(*[f.split()[0] for f in SUBMISSIONS.split(", ")]), root, "submissions", "bundle_id")
    return n


def submissions(spark: SparkSession, root: str, assignment: str | None = None) -> DataFrame:
    """Submissions of live bundles with the state of their archive; those that could not be read stay, with their error.

    ``assignment`` reads only that one's bundles.
    """
    live = live_bundles(spark, root).select("assignment", "bundle_id", "filename", "version")
    if assignment is not None:
        live = live.filter(F.col("assignment") == assignment)
    own = table(spark, root, "submissions").join(live, ["assignment", "bundle_id"])
    return own.join(table(spark, root, "archives").drop("bundle_id"), "archive_hash")


def submission_files(spark: SparkSession, root: str, assignment: str | None = None) -> DataFrame:
    """(submission_id, relative_path, sha256, size_bytes, recovered, forms) of live submissions; equal archives share their stored files."""
    own = submissions(spark, root, assignment).select("submission_id", "archive_hash")
    return own.join(table(spark, root, "files").drop("bundle_id", "index"), "archive_hash").drop("archive_hash")


def delete_bundle(spark: SparkSession, root: str, assignment: str, bundle_id: str) -> int:
    """Log a deletion: the bundle, its submissions and all runs of the assignment are gone at once. Returns how many bundles remain.

    Nothing is rewritten; :func:`compact` frees the space later.
    """
    live = live_bundles(spark, root).filter(F.col("assignment") == assignment)
    if live.filter(F.col("bundle_id") == bundle_id).isEmpty():
        raise FileNotFoundError(f"no bundle {bundle_id} in {assignment}")
    append_event(spark, root, assignment=assignment, kind="delete", bundle_id=bundle_id)
    return live_bundles(spark, root).filter(F.col("assignment") == assignment).count()


def record_run(spark: SparkSession, root: str, assignment: str, run_id: str) -> None:
    """Note a run of the assignment's present version, whole before it is named."""
    version = live_bundles(spark, root).filter(F.col("assignment") == assignment).agg(F.max("version")).first()[0]
    if version is None:
        raise FileNotFoundError(f"no bundle in {assignment}")
    one = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(version).alias("version"), F.current_timestamp().alias("created"))
    one.coalesce(1).write.mode("error").parquet(f"{root}/runs/assignment={assignment}/run={run_id}")


def live_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs (assignment, run_id, version, created) that read what their assignment holds now; a semi join drops all stale ones."""
    now = live_bundles(spark, root).select("assignment", "version").distinct()
    return table(spark, root, "runs").join(now, ["assignment", "version"], "left_semi").select("assignment", "run_id", "version", "created")


def published(spark: SparkSession, root: str) -> DataFrame:
    """(assignment, run_id): the newest live run of each assignment, none where all are stale."""
    return live_runs(spark, root).groupBy("assignment").agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))


def compact(spark: SparkSession, root: str) -> None:
    """Free what deleted bundles hold. Archives that a live bundle still names move to it first.

    Partitions are removed only after what moved is written, so a run that breaks off can be repeated.
    """
    events = table(spark, root, "events")
    live = live_bundles(spark, root).select("bundle_id").distinct()
    gone = materialize(events.filter("kind = 'delete'").select("bundle_id").distinct().join(live, "bundle_id", "left_anti"), "gone")
    needed = table(spark, root, "submissions").join(live, "bundle_id").groupBy("archive_hash").agg(F.min("bundle_id").alias("heir"))
    for name in ("files", "archives"):
        rows = table(spark, root, name)
        moved = materialize(rows.join(gone, "bundle_id", "left_semi").join(needed, "archive_hash").drop("bundle_id").withColumnRenamed("heir", "bundle_id"), "moved")
        heirs = moved.select("bundle_id").distinct()
        stay = rows.join(heirs, "bundle_id").join(moved.select("archive_hash").distinct(), "archive_hash", "left_anti")
        replace_partitions(moved.select(rows.columns).unionByName(stay.select(rows.columns)), root, name, "bundle_id")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for row in gone.toLocalIterator():  # a folder each
        for name in ("files", "archives", "submissions"):
            place = hadoop(f"{root}/{name}/bundle_id={row['bundle_id']}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
