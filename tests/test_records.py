"""The cache as a stream, folded logs, the catalogue and read models."""

import random

import pytest
from pyspark.sql import functions as F

from kinmesh.operators import read_models as RM
from kinmesh.operators import run_log as L
from kinmesh.sources import catalogue as K
from kinmesh.streaming import cache as C

EVENT = "run string, seq bigint, at timestamp, kind string, stage string, message string, current bigint, total bigint, error string"


def requests(n, seed):
    rng = random.Random(seed)
    rows = [(k - 100, "m", f"h{k}", "seed", bool(k % 2)) for k in range(6)]
    return rows + [(k, rng.choice("mn"), f"h{rng.randrange(12)}", rng.choice(["ask", "ask", "ask", "force"]), None) for k in range(n)]


def plain_counts(rows):
    held, out = {}, {}
    for _, model, key, kind, valid in sorted(rows, key=lambda r: r[0]):
        if kind == "seed":
            held[model, key] = valid
            continue
        state = "bypassed" if kind == "force" else {None: "miss", True: "hit", False: "stale"}[held.get((model, key))]
        held[model, key] = True
        counts = out.setdefault(model, dict.fromkeys(C.STATES, 0))
        counts[state] += 1
    return {m: (sum(c.values()), *c.values()) for m, c in out.items()}


def totals(df):
    return {r.model: (r.requests, r.hit, r.miss, r.stale, r.bypassed) for r in df.collect()}


@pytest.mark.parametrize("cuts", [[], [3, 40], [5, 6, 7, 60, 100]])
def test_stream_counts_as_the_batch_after_any_cut_and_restart(spark, tmp_path, cuts):
    """Each part of the requests arrives as a file and is taken by a query of its own, which stops: as many restarts as parts."""
    rows = requests(120, 3)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    edges = [0, *cuts, len(rows)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            spark.createDataFrame(rows[a:b], C.REQUESTS).coalesce(1).write.parquet(f"{source}/part={k}")
            stream = spark.readStream.schema(C.REQUESTS).parquet(f"{source}/*")
            query = C.cache_stream(stream, out, state)
            query.awaitTermination()
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_counts(rows)
    assert totals(C.stream_totals(spark, out)) == want == totals(C.replayed_counters(spark.createDataFrame(rows, C.REQUESTS)))


def log(n, seed):
    rng = random.Random(seed)
    stages = ["queued", "ingestion", "embeddings", "cluster", "artifacts"]
    rows, at = [], 0
    for run in ("r1", "r2", "r3"):
        for k in range(n):
            at += 1
            stage = stages[min(len(stages) - 1, k * len(stages) // n)] if rng.random() < 0.8 else None
            counted = rng.random() < 0.6
            rows.append((run, at, None, "step", stage, rng.choice([None, f"note {k}"]), rng.randint(0, 40) if counted else None, rng.choice([40, 0]) if counted else None, None))
        if run != "r3":
            at += 1
            rows.append((run, at, None, "failed" if run == "r2" else "published", "failed" if run == "r2" else "published", "end", None, None, "broken" if run == "r2" else None))
    return rows


def sequential(rows):
    """One event after the other, as a reporter writes them."""
    out = {}
    for run, seq, _, kind, stage, message, current, total, error in sorted(rows, key=lambda r: r[1]):
        s = out.setdefault(run, {"status": "queued", "stage": None, "message": None, "current": None, "total": None, "tail": [], "stages": [], "error": None})
        for name, value in (("stage", stage), ("message", message), ("current", current), ("total", total), ("error", error)):
            s[name] = value if value is not None else s[name]
        s["tail"] = [*s["tail"], seq][-8:]
        if stage is not None and stage not in s["stages"]:
            s["stages"].append(stage)
        s["newest"] = stage or s.get("newest")
        s["status"] = kind if kind in L.ENDS else "running" if s["status"] == "queued" and s["stages"] else s["status"]
    shown = {}
    for run, s in out.items():
        state = lambda x, s=s: "done" if x != s["newest"] or s["status"] == "published" else "failed" if s["status"] == "failed" else "running"
        percent = round((s["current"] or 0) / s["total"] * 100) if s["total"] else 0
        shown[run] = (s["status"], s["stage"], s["message"], percent, s["tail"], {x: state(x) for x in s["stages"]}, s["error"] if s["status"] == "failed" else None)
    return shown


def folded(df):
    return {r.run: (r.status, r.stage, r.message, r.percent, [t.seq for t in r.tail], {s.stage: s.state for s in r.stages}, r.error) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_folds_merge_to_the_sequential_state(spark, parts):
    rows = log(25, parts)
    df = spark.createDataFrame(rows, EVENT)
    want = sequential(rows)
    assert folded(L.fold_log(df)) == want
    cut = df.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(parts)))
    pieces = [L.partial_states(cut.filter(F.col("part") == k).drop("part")) for k in range(parts)]
    assert folded(L.run_states(L.merge_states(*pieces))) == want
    if parts == 3:  # merged in steps
        assert folded(L.run_states(L.merge_states(pieces[2], L.merge_states(pieces[0], pieces[1])))) == want
    assert L.fold_log(df.limit(0)).count() == 0


def test_catalogue_reads_what_is_asked(spark, tmp_path):
    root = str(tmp_path)
    tables = {a: spark.createDataFrame([(k, None if k else "x") for k in range(3)], "n long, s string") for a in K.ARTIFACTS}
    K.store_run(tables, root, "lab1", "run1")
    K.store_run({a: t for a, t in tables.items() if a != "neighbors"}, root, "lab1", "run2")
    K.store_run({a: t for a, t in tables.items() if a not in ("clusters", "projection")}, root, "lab2", "run3")
    found = K.run_artifacts(spark, root, "run1")
    assert set(found) == set(K.ARTIFACTS) and [r.payload for r in found["overview"].collect()] == ['{"n":0,"s":"x"}', '{"n":1,"s":null}', '{"n":2,"s":null}']
    pruned = found["clusters"]._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert all(f"isnotnull({c}" in pruned for c in ("assignment", "run_id", "artifact")) and "PushedFilters: []" in pruned
    # an optional one may be missing, others may not, and a run must be there
    assert K.run_artifacts(spark, root, "run2")["neighbors"].count() == 0
    with pytest.raises(FileNotFoundError, match="projection, clusters"):
        K.run_artifacts(spark, root, "run3")
    with pytest.raises(FileNotFoundError, match="no run"):
        K.run_artifacts(spark, root, "run9")
    # an artefact without rows is there
    K.store_artifact(tables["overview"].limit(0), root, "lab1", "run2", "neighbors")
    assert "neighbors" in K.present(spark, root, "lab1", "run2")
    told = {(r.assignment, r.run_id): (r.complete, r.missing) for r in K.complete_runs(spark, root).collect()}
    assert told == {("lab1", "run1"): (True, []), ("lab1", "run2"): (True, []), ("lab2", "run3"): (False, ["projection", "clusters"])}
    assert {r.run_id for r in K.complete_runs(spark, root, "lab2").collect()} == {"run3"}
    # written again, a run's artefact is replaced
    K.store_artifact(tables["overview"].limit(1), root, "lab1", "run1", "overview")
    assert K.run_artifacts(spark, root, "run1")["overview"].count() == 1
    assert K.complete_runs(spark, str(tmp_path / "none")).count() == 0


def test_lists_follow_their_order(spark):
    bundles = spark.createDataFrame([("a", "b2", 2021, "2024-01-02", 3), ("a", "b1", 2020, "2024-01-05", 0), ("b", "b3", 2020, "2024-03-01", 2), ("a", "b0", 2021, "2024-01-01", None)], "assignment string, bundle_id string, year int, created string, valid_zip_count int")
    manifests = spark.createDataFrame([("b1", 7)], "bundle_id string, archives int")
    rows = K.listed_bundles(bundles, manifests).orderBy("assignment", "place").collect()
    assert [(r.bundle_id, r.archives) for r in rows] == [("b1", 7), ("b0", None), ("b2", None), ("b3", None)]
    told = K.listed_assignments(bundles).orderBy("place").collect()
    assert [(r.assignment, r.bundles, r.years, r.valid) for r in told] == [("b", 1, [2020], 2), ("a", 3, [2020, 2021], 3)]


def test_documents_hold_no_more_than_their_lists(spark):
    names = [f"s{k}" for k in range(9)]
    members = spark.createDataFrame([("expr", n, "s0", False, 1.0) for n in names] + [("sem", "s0", None, True, 0.0)], "space string, sid string, cluster string, is_noise boolean, strength double")
    edges = spark.createDataFrame([("expr", "s0", n, k / 10) for k, n in enumerate(names) if k], "space string, i string, j string, cal double")
    weighted = spark.createDataFrame([("expr", "s0", f"f{k:02d}", (-1.0) ** k * k) for k in range(30)], "space string, sid string, feature string, w double")
    docs = {r.sid: r.spaces for r in RM.submission_documents(members, edges, weighted, neighbors=3, signals=4).collect()}
    hub = docs["s0"][0]
    assert hub.degree == 8 and [n.other for n in hub.neighbors] == ["s8", "s7", "s6"] and [s.feature for s in hub.signals] == ["f29", "f28", "f27", "f26"]
    assert docs["s0"][1].neighbors == [] and docs["s3"][0].signals == [] and [n.other for n in docs["s3"][0].neighbors] == ["s0"]
    assert len(docs) == 9
