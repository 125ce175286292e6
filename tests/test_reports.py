"""Reports that queries do not reach: long numbers in labels, lacking artefacts, changed inputs."""

from pyspark.sql import functions as F

from kinmesh.operators import reports as R
from kinmesh.operators import struct_features as ST
from kinmesh.plans import basket


def test_labels_sort_by_value_whatever_their_length(spark):
    labels = ["a2", "a10", "a0003", "a" + "9" * 21, "a1" + "0" * 30, "a" + "0" * 30 + "4", "b1", "a"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in labels], "s string").orderBy(R.natural_key(F.col("s"))).collect()]
    assert got == ["a", "a2", "a0003", "a" + "0" * 30 + "4", "a10", "a" + "9" * 21, "a1" + "0" * 30, "b1"]
    keys = spark.createDataFrame([("x" + "1" * 25,), ("x" + "1" * 24 + "2",)], "s string").select(R.natural_key(F.col("s")).alias("k")).distinct()
    assert keys.count() == 2


def test_a_lab_lacks_what_is_named(spark):
    labs = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "lab string")
    runs = spark.createDataFrame([("a", "r1", "m", 1), ("a", "r2", "m", 2), ("b", "r3", "m", 1), ("b", "r4", "n", 5)], "lab string, run_id string, model string, created_at long")
    parts = spark.createDataFrame([("r2", n) for n in R.REQUIRED] + [("r3", "overview"), ("r3", "other"), ("r4", "clusters")], "run_id string, name string")
    got = {r.lab: (r.run_id, r.state, r.reason, r.lacking) for r in R.workspace_runs(labs, runs, parts, "m").collect()}
    assert got == {"a": ("r2", "ready", None, []), "b": ("r3", "missing", "published_run_without_complete_artifacts", ["year_stats", "year_similarity"]), "c": (None, "missing", "no_published_run_for_model", None)}
    assert {r.lab: r.run_id for r in R.workspace_runs(labs, runs, parts).collect()} == {"a": "r2", "b": "r4", "c": None}
    points = spark.createDataFrame([("a", 2020), ("a", 2020), ("a", 2022), ("b", 2019)], "lab string, year int")
    row = R.workspace_totals(R.workspace_runs(labs, runs, parts, "m"), points).first()
    assert (row.labs, row.missing, row.submissions, row.years, row.transitions) == (1, 2, 3, [2020, 2022], ["2020-2022"])


def test_small_report_columns(spark):
    df = spark.createDataFrame([(0.5, 0.0, 2.0), (1.0, 1.0, 1.0)], "v double, lo double, hi double")
    assert [r[0] for r in df.select(R.ratio(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == [0.25, 1.0]
    assert callable(ST.tree_previews)


def test_shared_tables_follow_the_files(spark, tmp_path):
    """A result is shared while the input files stay as they are, and built anew when one changes."""
    calls = []
    build = basket.once(lambda s, d: calls.append(d) or len(calls))
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    assert [build(spark, str(tmp_path)), build(spark, str(tmp_path))] == [1, 1]
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/a.parquet")
    assert build(spark, str(tmp_path)) == 2
