"""The bundle store: reuse, restart, deletion, stale runs and compaction."""

import pytest
from pyspark.sql import functions as F

from kinmesh.sources import store
from tests.test_sources import packed

A = packed({"src/A.java": b"class A { int x = 1; // note\n}", "notes.txt": b"n"})
B = packed({"src/B.java": b"class B {}", "src/Bad.java": b"\xff class"})
C = packed({"README.md": b"hi"})


def bundle(spark, **archives):
    blob = packed({f"{name}.zip": data for name, data in archives.items()})
    return spark.createDataFrame([("bundle.zip", bytearray(blob))], "bundle string, content binary")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ingest_reuses_what_is_stored(spark, tmp_path):
    root = str(tmp_path)
    store.import_bundle(spark, root, "lab", 2020, "b1", bundle(spark, alice=A, bob=B, carol=C, broken=b"no zip"))
    told = {r.name: r for r in store.submissions(spark, root).collect()}
    assert {n: r.status for n, r in told.items()} == {"alice": "ok", "bob": "ok", "carol": "empty", "broken": "error"}
    assert (told["bob"].relevant, told["bob"].recovered, told["alice"].ignored, told["broken"].error) == (2, 1, 1, "no readable ZIP archive")
    assert {r.year for r in told.values()} == {2020} and len({r.submission_id for r in told.values()}) == 4
    # the second bundle brings one new archive; equal ones are not opened again
    second = bundle(spark, alice2=A, dave=packed({"D.java": b"class D {}"}), alice3=A)
    new = store.ingest(spark, root, second.withColumns({"bundle_id": F.lit("b2"), "assignment": F.lit("lab"), "year": F.lit(2021)}))
    assert new == 1
    again = store.ingest(spark, root, second.withColumns({"bundle_id": F.lit("b2"), "assignment": F.lit("lab"), "year": F.lit(2021)}))
    assert again == 0
    # not named by an event yet, so not live
    assert store.submissions(spark, root).count() == 4
    store.import_bundle(spark, root, "lab", 2021, "b2", second)
    assert store.submissions(spark, root).count() == 7 and store.table(spark, root, "archives").count() == 5
    files = store.submission_files(spark, root)
    assert files.count() == 1 + 2 + 1 + 1 + 1
    forms = files.filter("relative_path = 'src/A.java'").select("forms.*").first()
    assert forms.raw.startswith("class A") and "note" not in forms.no_comments and "NUM" in forms.masked_literals


def test_a_killed_ingest_repeats_to_the_same_tables(spark, tmp_path, monkeypatch):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    content = bundle(spark, alice=A, bob=B)
    store.import_bundle(spark, one, "lab", 2020, "b1", content)
    real = store.replace_partitions

    def broken(df, root, name, by):
        if name == "archives":
            raise RuntimeError("executor lost")
        real(df, root, name, by)

    monkeypatch.setattr(store, "replace_partitions", broken)
    with pytest.raises(RuntimeError):
        store.import_bundle(spark, two, "lab", 2020, "b1", content)
    assert store.table(spark, two, "files").count() == 3 and store.submissions(spark, two).count() == 0
    monkeypatch.setattr(store, "replace_partitions", real)
    store.import_bundle(spark, two, "lab", 2020, "b1", content)
    for name in ("files", "archives", "submissions"):
        columns = [c for c in store.table(spark, one, name).columns if c != "forms"]
        assert rows(store.table(spark, one, name), *columns) == rows(store.table(spark, two, name), *columns)


def test_deletion_reaches_submissions_and_runs(spark, tmp_path):
    root = str(tmp_path)
    store.import_bundle(spark, root, "lab", 2020, "b1", bundle(spark, alice=A, bob=B))
    store.import_bundle(spark, root, "other", 2020, "o1", bundle(spark, eve=C))
    store.record_run(spark, root, "lab", "run1")
    store.record_run(spark, root, "other", "runo")
    assert rows(store.published(spark, root), "assignment", "run_id") == [("lab", "run1"), ("other", "runo")]
    store.import_bundle(spark, root, "lab", 2021, "b2", bundle(spark, alice=A))  # an import makes run1 stale
    assert rows(store.published(spark, root), "assignment", "run_id") == [("other", "runo")]
    store.record_run(spark, root, "lab", "run2")
    assert store.delete_bundle(spark, root, "lab", "b1") == 1
    assert rows(store.published(spark, root), "assignment", "run_id") == [("other", "runo")]
    assert rows(store.submissions(spark, root, "lab"), "bundle_id", "name", "status") == [("b2", "alice", "ok")]
    with pytest.raises(FileNotFoundError):
        store.delete_bundle(spark, root, "lab", "b1")
    # alice's archive was stored by b1; it moves to b2 before b1's space is freed, and a second run changes nothing
    for _ in range(2):
        store.compact(spark, root)
        assert rows(store.table(spark, root, "archives"), "bundle_id") == [("b2",), ("o1",)]
        assert rows(store.submission_files(spark, root, "lab"), "relative_path") == [("src/A.java",)]
    store.record_run(spark, root, "lab", "run3")
    assert ("lab", "run3") in rows(store.published(spark, root), "assignment", "run_id")


def test_keys_and_years_are_checked(spark, tmp_path):
    content = bundle(spark, alice=A)
    for assignment, year, name in (("../up", 2020, "b"), ("lab", 1800, "b"), ("lab", 2020, "a/b")):
        with pytest.raises(ValueError):
            store.import_bundle(spark, str(tmp_path), assignment, year, name, content)
    assert store.live_bundles(spark, str(tmp_path)).count() == 0 and store.published(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        store.record_run(spark, str(tmp_path), "lab", "r")
