"""Blocked pair products and the cluster plan."""

import random

import pytest

from kinmesh.operators import blocked
from kinmesh.operators import clusters as C
from kinmesh.operators import similarity as S
from tests.test_operators import SIX, nodes, pairs_of

KIND = "space string, sid string, feature string, w double, mean double, std double"


@pytest.mark.parametrize(("sids", "features"), [(3, 5), (7, 10_000), (64, 2)])
def test_blocks_equal_the_join(spark, sids, features):
    """Also with a feature that every sid has, sids that share nothing, negative weights and columns without spread."""
    rng = random.Random(sids)
    rows = []
    for space, n in (("expr", 23), ("sem", 9), ("one", 1)):
        for k in range(n):
            own = {"hot:all": 1.0 + k % 3} | {rng.choice(["a:", "", "b:"]) + f"f{rng.randrange(12)}": round(rng.uniform(-0.3, 2), 3) for _ in range(rng.randrange(8))} | ({f"own{k}": 1.5} if k % 4 else {})
            if k == 5:
                own = {"alone": 2.0}
            rows += [(space, f"s{k:02d}", f, w, 0.4, 0.0 if f == "f3" else 0.7) for f, w in own.items()]
    df = spark.createDataFrame(rows, KIND)
    key = lambda r: (r.space, r.i, r.j)
    got = {key(r): r for r in blocked.block_components(df, sids, features).collect()}
    want = {key(r): r for r in S.pair_components(df).collect()}
    assert set(got) == set(want) and len(want) == 23 * 22 // 2 + 9 * 8 // 2
    for k, r in want.items():
        assert all(abs(r[c] - got[k][c]) < 1e-9 for c in ("profile", "contrast", "overlap", "size", "rare_overlap")), (k, r, got[k])


def test_blocks_of_an_empty_table(spark):
    assert blocked.block_components(spark.createDataFrame([], KIND)).count() == 0


def test_each_space_takes_its_way(spark):
    edge = lambda space, *pairs: [(space, a, b, cal, shared) for a, b, cal, shared in pairs]
    # two dense groups and a stray point
    table = pairs_of(spark, SIX, "dense").unionByName(pairs_of(spark, {"ab": 0.91, "ac": 0.89, "bc": 0.90, "ad": 0.12, "bd": 0.10, "cd": 0.09}, "four"))
    # each point joins the ones before it farther away: all noise
    chain = {f"{a}{b}": round(0.7 - 0.08 * k, 3) for k, b in enumerate("bcdefgh") for a in "abcdefgh"[: k + 1]}
    table = table.unionByName(pairs_of(spark, chain, "struct")).unionByName(pairs_of(spark, chain, "bare"))
    table = table.unionByName(pairs_of(spark, {"ab": None, "ac": 0.5, "bc": float("nan")}, "broken"))
    own = nodes(spark, "abcdef", "dense").unionByName(nodes(spark, "abcd", "four")).unionByName(nodes(spark, "abcdefgh", "struct")).unionByName(nodes(spark, "abcdefgh", "bare"))
    own = own.unionByName(nodes(spark, "abc", "broken")).unionByName(nodes(spark, "x", "single"))
    rows = edge("struct", ("a", "b", 0.7, 1), ("a", "c", 0.62, 1), ("b", "c", 0.62, 1), ("g", "h", 0.1, 0)) + edge("broken", ("a", "c", 0.5, 0))
    edges = spark.createDataFrame(rows, "space string, i string, j string, cal double, shared int")
    members, spaces = C.cluster_spaces(own, table, edges)
    told = {r.space: (r.method, r.fallback, r.reason, r.n, r.clusters) for r in spaces.collect()}
    assert told["dense"] == ("hdbscan_precomputed", False, None, 6, 2)
    assert told["struct"][:3] == ("graph_support_components", True, "all_noise_graph_support_fallback")
    assert told["bare"] == ("hdbscan_precomputed", False, None, 8, 0)
    assert told["broken"] == ("connected_components", True, "hdbscan_unavailable_or_failed", 3, 2)
    assert told["single"] == ("singleton", False, None, 1, 1)
    got = {(r.space, r.sid): r.cluster for r in members.collect()}
    assert [got["dense", s] for s in "abcdef"] == ["a", "a", "a", "d", "d", None]
    assert [got["struct", s] for s in "abcdefgh"] == ["a", "a", "a", *[None] * 5]
    assert [got["broken", s] for s in "abc"] == ["a", "b", "a"] and got["single", "x"] == "x"
    assert len(got) == 30 and told["four"][3] == 4


def test_a_plan_without_spaces(spark):
    none = nodes(spark, "")
    members, spaces = C.cluster_spaces(none, pairs_of(spark, {}), spark.createDataFrame([], "space string, i string, j string, cal double, shared int"))
    assert members.count() == 0 and spaces.count() == 0


def test_the_embedding_engine_runs_from_chunks_to_overview(spark):
    from kinmesh.operators import engines as E

    rng = random.Random(2)
    own = spark.createDataFrame([(k,) for k in range(9)], "sid long")
    # three groups of near vectors, one submission without chunks, one chunk of another size
    rows = [(k, c, 1.0 + c, [float((k // 3 == d) * 5) + rng.random() * 0.1 for d in range(3)]) for k in range(8) for c in range(2)] + [(0, 9, 5.0, [1.0])]
    out = E.embedding_engine(own, spark.createDataFrame(rows, "sid long, place int, weight double, v array<double>"))
    reps = {r.sid: r for r in out["representations"].collect()}
    assert len(reps) == 9 and reps[8].v == [0.0, 0.0, 0.0] and reps[8].chunks == 0 and abs(sum(x * x for x in reps[0].v) - 1) < 1e-9
    pairs = {(r.i, r.j): r.cal for r in out["pairs"].collect()}
    assert len(pairs) == 36 and pairs[0, 1] > 0.99 and pairs[0, 3] < 0.2 and pairs[7, 8] == 0
    row = out["overview"].first()
    assert (row.space, row.nodes, row.pairs) == ("embedding", 9, 36) and row.edges == out["edges"].count()
    groups = {}
    for r in out["members"].collect():
        groups.setdefault(r.cluster, set()).add(r.sid)
    assert {0, 1, 2} <= next(g for g in groups.values() if 0 in g) and 8 not in next(g for g in groups.values() if 0 in g)


def test_pairs_of_a_space_with_one_chunk_are_not_shuffled(spark):
    rows = [("sem", k, f"f{m}", 1.0 + (k * m) % 4, 0.5, 0.7) for k in range(20) for m in range(1, 6)]
    df = spark.createDataFrame(rows, KIND.replace("sid string", "sid bigint"))
    out = blocked.block_components(df, 6)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    one, more = plan.split("MapInArrow")[1:]
    assert "CartesianProduct" in one and "Exchange" not in plan.split("MapInArrow")[0].split("HashAggregate")[0]
    assert out.count() == 190 and "Join" not in one


@pytest.mark.parametrize("n", [12, 20, 75])
def test_edges_of_vectors_are_those_of_the_pair_table_without_one(spark, monkeypatch, n):
    from kinmesh.operators import engines as E
    from kinmesh.operators import neighbors as N
    from kinmesh.operators import search
    from kinmesh.session import materialize

    monkeypatch.setattr(search, "OWN_BLOCK", 8)
    rng = random.Random(n)
    rows = [(k, [0.0] * 4 if k % 7 == 3 else rng.choice([[1.0, 0.0, 0.0, 0.0], [0.6, 0.8, 0.0, 0.0], [rng.gauss(0, 0.5) for _ in range(4)]])) for k in range(n)]
    vectors = materialize(spark.createDataFrame(rows, "sid bigint, v array<double>"), "vectors")
    pairs = materialize(E.embedding_pairs(vectors), "pairs")
    want = N.mutual_edges(N.adaptive_topk(pairs)).select("i", "j", "rank", "cal").collect()
    written = []
    monkeypatch.setattr(E, "embedding_pairs", lambda v: written.append(v) or pairs)
    assert sorted(E.graph_edges(vectors).select("i", "j", "rank", "cal").collect()) == sorted(want) and len(want) > n // 4
    assert bool(written) == (n < 20)
