import io
import zipfile

from kinmesh.sources import archives as A
from kinmesh.sources import tables as T
from kinmesh.streaming.bundles import classify_arrivals


def packed(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def bundle(tmp_path, name="b.zip"):
    alice = packed({"src/Main.java": b"class Main {}", "__MACOSX/src/Main.java": b"x", "src/_Skip.java": b"x", "src/\xff.java".encode("latin-1").decode("latin-1"): b"\xffclass"})
    blob = packed({"exports/alice.zip": alice, "exports/bob.zip": packed({"README.md": b"hi"}), "exports/broken.zip": b"no zip", "exports/Loose.java": b"class L {}", "notes.txt": b"n", "__MACOSX/alice.zip": alice})
    (tmp_path / name).write_bytes(blob)
    return str(tmp_path)


def test_nested_archives_become_files(spark, tmp_path):
    subs = A.submission_archives(A.read_bundles(spark, bundle(tmp_path))).withColumnRenamed("name", "submission_id")
    assert sorted(r.submission_id for r in subs.collect()) == ["alice", "bob", "broken"]
    files = A.source_files(subs).collect()
    assert sorted(r.basename for r in files) == ["Main.java", "ÿ.java"]
    assert {r.submission_id: r.status for r in A.submission_status(subs).collect()} == {"alice": "ok", "bob": "empty", "broken": "error"}


def test_a_corrupt_bundle_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "bad.zip").write_bytes(b"no zip at all")
    with pytest.raises(Exception, match="no readable ZIP archive"):
        A.submission_archives(A.read_bundles(spark, str(tmp_path))).collect()


def test_bundle_entries_are_classified(spark, tmp_path):
    found = A.classify_bundle(A.read_bundles(spark, bundle(tmp_path)))
    assert {(r.path, r.kind, r.reason) for r in found.collect()} == {
        ("exports/alice.zip", "valid", None), ("exports/bob.zip", "ignored_zip", "zip_without_java"), ("exports/broken.zip", "ignored_zip", "invalid_zip"),
        ("exports/Loose.java", "loose", "loose_java_file"), ("notes.txt", "loose", "not_a_submission_zip"),
    }
    row = A.manifest(found, valid_most=5, other_most=1).first()
    assert (row.valid_count, row.loose_count, row.ignored_zip_count, row.truncated, row.loose) == (1, 2, 2, True, ["exports/Loose.java"])


def test_path_predicates(spark):
    paths = {"src/Main.java": True, "src/_Main.java": False, "src/.Hidden.java": False, "__MACOSX/Main.java": False, "a/._x/Main.java": False, "MAIN.JAVA": True, ".java": False, "x/build/A.java": False, "a.txt": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.withColumn("ok", A.relevant_source(df.p)).collect()} == paths


def test_stream_takes_each_bundle_once(spark, tmp_path):
    src, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    src.mkdir()
    bundle(src, "one.zip")
    for _ in range(2):
        classify_arrivals(spark, str(src), str(out), str(state)).awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 5
    bundle(src, "two.zip")
    classify_arrivals(spark, str(src), str(out), str(state)).awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 10


def test_publishing_needs_every_artefact(spark, tmp_path):
    import pytest

    pointer, run = str(tmp_path / "current"), str(tmp_path / "run1")
    assert T.published(spark, pointer) is None
    T.write_artifacts({"graph": spark.range(3)}, run)
    with pytest.raises(FileNotFoundError):
        T.publish(spark, run, ("graph", "clusters"), pointer, "run1")
    T.write_artifacts({"clusters": spark.range(1)}, run)
    T.publish(spark, run, ("graph", "clusters"), pointer, "run1")
    assert T.published(spark, pointer) == "run1"
    T.publish(spark, run, ("graph", "clusters"), pointer, "run2")
    assert T.published(spark, pointer) == "run2"
    pairs = spark.range(12).selectExpr("'expr' AS space", "id AS i", "id + 1 AS j")
    T.write_pairs(pairs, str(tmp_path / "pairs"), chunk=5)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 12
