"""Nested ZIP archives as tables: a bundle holds one archive per submission, an archive its source files.

``binaryFile`` reads bundles; a generator in ``mapInArrow`` opens them, one at a time. Inner
entries are classified by DataFrame predicates on their paths.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a path that make an entry irrelevant.
IGNORED_PARTS = ("__MACOSX", "target", "build", "out", "bin", "dist", ".gradle", ".idea", ".git", "node_modules", ".DS_Store", "Thumbs.db")


#: Unpacked bytes of one file up to which an archive is read.
MOST_BYTES = 1 << 30


def ignored(path: Column) -> Column:
    """Any part is in the ignored set or begins with ``._``."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(*IGNORED_PARTS) | p.startswith("._"))


def relevant_source(path: Column, suffix: str = ".java") -> Column:
    """Not ignored, of the suffix in any case, with a stem that is there and begins with neither . nor _."""
    base = F.element_at(F.split(path, "/"), -1)
    return ~ignored(path) & F.lower(base).endswith(suffix) & (F.length(base) > len(suffix)) & ~base.rlike("^[._]")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, content) of all files under a path; the content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("bundle"), "content")


def entries(archives: DataFrame, key: str, content: str = "content", wanted: Callable[[str], bool] | None = None, strict: bool = False) -> DataFrame:
    """(key, index, path, data, corrupt): a row for each file of each archive; a corrupt archive gives one row without a path, or is an
    error if ``strict``.

    Files whose path is not ``wanted`` are listed without data and are not unpacked; nor is an
    archive with a file that says it is larger than MOST_BYTES, which counts as corrupt.
    """
    schema = pa.schema([(key, pa.string()), ("index", pa.int32()), ("path", pa.string()), ("data", pa.binary()), ("corrupt", pa.bool_())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(blob or b"")) as z:
                        if any(i.file_size > MOST_BYTES for i in z.infolist() if wanted is None or wanted(i.filename)):
                            raise zipfile.BadZipFile(f"a file of {name} is too large")
                        for k, info in enumerate(i for i in z.infolist() if not i.is_dir()):
                            take = wanted is None or wanted(info.filename)
                            yield pa.RecordBatch.from_pylist([{key: name, "index": k, "path": info.filename, "data": z.read(info) if take else None, "corrupt": False}], schema)
                except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zipfile.zlib.error) as cause:
                    if strict:
                        raise ValueError(f"no readable ZIP archive: {name}") from cause
                    yield pa.RecordBatch.from_pylist([{key: name, "index": 0, "path": None, "data": None, "corrupt": True}], schema)

    return archives.select(F.col(key).cast("string"), F.col(content)).mapInArrow(unpack, f"{key} string, index int, path string, data binary, corrupt boolean")


def submission_archives(bundles: DataFrame) -> DataFrame:
    """(bundle, name, archive_path, index, content): the nested archives that are not ignored. A corrupt bundle is an error."""
    every = entries(bundles, "bundle", wanted=lambda path: path.lower().endswith(".zip"), strict=True)
    e = every.filter(F.lower("path").endswith(".zip") & ~ignored(F.col("path")))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.zip$", "")
    return e.select("bundle", name.alias("name"), F.col("path").alias("archive_path"), "index", F.col("data").alias("content"))


def source_files(submissions: DataFrame, key: str = "submission_id") -> DataFrame:
    """(key, relative_path, basename, sha256, size_bytes, text) of the relevant files; text is UTF-8 with replacement."""
    e = entries(submissions, key, wanted=lambda path: path.lower().endswith(".java")).filter(~F.col("corrupt") & relevant_source(F.col("path")))
    return e.select(key, F.col("path").alias("relative_path"), F.element_at(F.split("path", "/"), -1).alias("basename"), F.sha2("data", 256).alias("sha256"), F.length("data").cast("bigint").alias("size_bytes"), F.make_valid_utf8(F.col("data").cast("string")).alias("text"))


def submission_status(submissions: DataFrame, key: str = "submission_id") -> DataFrame:
    """(key, status, files, relevant, ignored): ok, empty, or error for a corrupt archive."""
    e = entries(submissions, key, wanted=lambda path: False)
    own = relevant_source(F.col("path"))
    stats = e.groupBy(key).agg(F.bool_or("corrupt").alias("corrupt"), F.count("path").alias("files"), F.count_if(F.coalesce(own, F.lit(False))).alias("relevant"))
    df = submissions.select(F.col(key).cast("string").alias(key)).distinct().join(stats, key, "left")
    status = F.when(F.col("corrupt"), "error").when(F.coalesce("relevant", F.lit(0)) == 0, "empty").otherwise("ok")
    return df.select(key, status.alias("status"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("relevant", F.lit(0)).alias("relevant"), (F.coalesce("files", F.lit(0)) - F.coalesce("relevant", F.lit(0))).alias("ignored"))


def classify_bundle(bundles: DataFrame) -> DataFrame:
    """(bundle, path, kind, reason): valid archives, loose files and ignored archives of every bundle.

    A nested archive is valid with at least one relevant file; else its reason is
    zip_without_java or invalid_zip. Other files are loose: loose_java_file or not_a_submission_zip.
    """
    top = entries(bundles, "bundle").filter(~F.col("corrupt") & ~ignored(F.col("path")))
    is_zip = F.lower("path").endswith(".zip")
    nested = top.filter(is_zip).withColumn("ref", F.to_json(F.struct("bundle", "path")))
    state = submission_status(nested.select("ref", F.col("data").alias("content")), "ref").select("ref", "status")
    judged = nested.select("bundle", "path", "ref").join(state, "ref")
    reason = F.when(F.col("status") == "error", "invalid_zip").when(F.col("status") == "empty", "zip_without_java")
    zips = judged.select("bundle", "path", F.when(reason.isNull(), "valid").otherwise("ignored_zip").alias("kind"), reason.alias("reason"))
    loose = top.filter(~is_zip).select("bundle", "path", F.lit("loose").alias("kind"), F.when(relevant_source(F.col("path")), "loose_java_file").otherwise("not_a_submission_zip").alias("reason"))
    return zips.unionByName(loose)


def manifest(classified: DataFrame, valid_most: int = 200, other_most: int = 300) -> DataFrame:
    """One row a bundle: counts, and the first paths of each kind with whether any were left out.

    Ranks prune before the lists are made, so a bundle of any size fills no list beyond its cap.
    """
    from pyspark.sql import Window

    most = F.when(F.col("kind") == "valid", valid_most).otherwise(other_most)
    ranked = classified.withColumn("n", F.row_number().over(Window.partitionBy("bundle", "kind").orderBy("path"))).filter(F.col("n") <= most)
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("path"))))
    lists = ranked.groupBy("bundle").agg(pick("valid").alias("valid"), pick("loose").alias("loose"), pick("ignored_zip").alias("ignored_zips"))
    counts = classified.groupBy("bundle").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("valid", "loose", "ignored_zip")])
    cut = (F.col("valid_count") > valid_most) | (F.col("loose_count") > other_most) | (F.col("ignored_zip_count") > other_most)
    return counts.join(lists, "bundle").withColumn("truncated", cut)
