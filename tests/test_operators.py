import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmesh.functions import features as FF
from kinmesh.functions import text as X
from kinmesh.operators import clusters as C
from kinmesh.operators import density as D
from kinmesh.operators import drift
from kinmesh.operators import model as M
from kinmesh.operators import neighbors as N
from kinmesh.operators import runs as R
from kinmesh.operators import search
from kinmesh.operators import similarity as S
from kinmesh.operators import text_features as T
from kinmesh.operators.components import connected_components

SIX = {"ab": 0.92, "ac": 0.88, "ad": 0.20, "ae": 0.18, "af": 0.05, "bc": 0.90, "bd": 0.22, "be": 0.18, "bf": 0.05, "cd": 0.25, "ce": 0.20, "cf": 0.08, "de": 0.90, "df": 0.10, "ef": 0.08}


def pairs_of(spark, values, space="expr"):
    return spark.createDataFrame([(space, k[0], k[1], v, v) for k, v in values.items()], "space string, i string, j string, raw double, cal double")


def nodes(spark, names, space="expr"):
    return spark.createDataFrame([(space, n) for n in names], "space string, sid string")


def test_similar_baskets_score_above_others(spark):
    rows = [("sem", s, f, v) for s, fs in {"a": {"import_family:java.util": 1.0, "collection_usage": 4.0}, "b": {"import_family:java.util": 1.0, "collection_usage": 5.0}, "c": {"import_family:java.io": 1.0, "io_usage": 4.0}}.items() for f, v in (fs | {"file_count": 1.0}).items()]
    rows += [("expr", s, f, v) for s, fs in {"a": {'expr_ngram:2:"ID + ID"': 4.0, 'line_skeleton:"return ID ;"': 2.0, "token_count": 100.0}, "b": {'expr_ngram:2:"ID + ID"': 5.0, 'line_skeleton:"return ID ;"': 2.0, "token_count": 98.0}, "c": {'expr_ngram:2:"if ( ID"': 4.0, 'line_skeleton:"while ( ID ) {"': 2.0, "token_count": 102.0}}.items() for f, v in fs.items()]
    long = spark.createDataFrame(rows, "space string, sid string, feature string, value double")
    w = M.weighted_features(long, M.feature_stats(long))
    raw = {(r.space, r.i + r.j): r.raw for r in S.hybrid(S.pair_components(w)).collect()}
    assert raw["sem", "ab"] > raw["sem", "ac"]
    assert raw["expr", "ab"] > 0.9 and raw["expr", "ac"] < 0.25
    assert abs(raw["sem", "ab"] - 0.979) < 2e-3 and abs(raw["sem", "ac"] - 0.102) < 2e-3


def test_fusion_ranks_the_supported_pair_first(spark):
    values = {"expr": (0.90, 0.20, 0.25), "struct": (0.85, 0.10, 0.15), "sem": (0.80, 0.12, 0.11)}
    rows = [(s, p[0], p[1], v, v) for s, vs in values.items() for p, v in zip(("ab", "ac", "bc"), vs, strict=True)]
    fused = {r.i + r.j: r.cal for r in S.fuse(spark.createDataFrame(rows, "space string, i string, j string, raw double, cal double")).collect()}
    assert fused["ab"] > max(fused["ac"], fused["bc"])


def test_density_clusters_find_both_groups_and_noise(spark):
    got = {r.sid: r.label for r in D.density_clusters(nodes(spark, "abcdef"), pairs_of(spark, SIX)).collect()}
    assert got["a"] == got["b"] == got["c"] >= 0 and got["d"] == got["e"] >= 0
    assert got["a"] != got["d"] and got["f"] == -1


def test_spanning_trees_weigh_what_a_plain_one_weighs(spark):
    rng = random.Random(11)
    names = [f"n{k:02d}" for k in range(30)]
    edges = {(a, b): round(rng.random(), 2) for k, a in enumerate(names) for b in names[k + 1 :]}
    reach = spark.createDataFrame([("expr", a, b, w) for (a, b), w in edges.items()], "space string, i string, j string, reach double")
    got = D.spanning_trees(nodes(spark, names), reach).collect()
    inside, want = {names[0]}, 0.0
    while len(inside) < len(names):
        w, x = min((w, b if a in inside else a) for (a, b), w in edges.items() if (a in inside) != (b in inside))
        inside.add(x)
        want += w
    assert len(got) == len(names) - 1 and abs(sum(r.reach for r in got) - want) < 1e-9


def test_drift_clusters_place_every_point(spark):
    rng = random.Random(42)
    points = [(rng.gauss(1, 0.02), rng.gauss(0, 0.02)) for _ in range(18)] + [(rng.gauss(0, 0.02), rng.gauss(1, 0.02)) for _ in range(18)] + [(0.7, 0.7), (0.6, 0.75), (0.75, 0.6)]
    rows = [("x", k, [a / (a * a + b * b) ** 0.5, b / (a * a + b * b) ** 0.5]) for k, (a, b) in enumerate(points)] + [("y", 100 + k, [1.0, 0.0]) for k in range(2)]
    got = {r.id: r.cluster for r in drift.drift_clusters(spark.createDataFrame(rows, "lab string, id bigint, v array<double>")).collect()}
    assert len(got) == 41 and all(c >= 0 for c in got.values())
    assert not {got[k] for k in range(18)} & {got[k] for k in range(18, 36)}


def test_fallback_clusters_recover_the_dense_part(spark):
    edges = pairs_of(spark, {"ab": 0.91, "ac": 0.89, "bc": 0.90}).withColumn("shared", F.lit(1))
    got = {r.sid: (r.cluster, r.is_noise) for r in C.fallback_clusters(nodes(spark, "abcd"), edges).collect()}
    assert got == {"a": ("a", False), "b": ("a", False), "c": ("a", False), "d": (None, True)}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(500, k) for k in range(501, 560)] + [(3, 3), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_topk_keeps_k_to_k_plus_two(spark):
    rng = random.Random(2)
    names = [f"n{k:02d}" for k in range(14)]
    rows = [("expr", a, b, v, v) for k, a in enumerate(names) for b in names[k + 1 :] for v in [round(rng.random(), 6)]]
    near = N.adaptive_topk(spark.createDataFrame(rows, "space string, i string, j string, raw double, cal double"))
    counts = [r["count"] for r in near.groupBy("src").count().collect()]
    assert len(counts) == 14 and min(counts) >= 4 and max(counts) <= 6
    edges = N.mutual_edges(near)
    assert edges.filter(F.col("i") >= F.col("j")).count() == 0
    assert N.degrees(nodes(spark, [*names, "alone"]), edges).filter("sid = 'alone'").first().degree == 0


#: source, text without comments, comment lines, comment characters
COMMENT_CASES = (
    ("int a; // one", "int a; ", 0, 4),
    ("int a; // one\nint b;", "int a; \nint b;", 1, 5),
    ("//\n//\n", "\n\n", 2, 2),
    ("a /* x */ b", "a  b", 0, 5),
    ("a /* x\n y */ b", "a \n b", 1, 8),
    ("a /* open\n end", "a \n", 1, 10),
    ("/**/b", "b", 0, 2),
    ("/*/ b */c", "c", 0, 6),
    ("s = \"// no\"; // yes", "s = \"// no\"; ", 0, 4),
    ("s = \"/* no */\";", "s = \"/* no */\";", 0, 0),
    ("c = '\"'; /* x */", "c = '\"'; ", 0, 5),
    ("s = \"a\\\"//b\"; //c", "s = \"a\\\"//b\"; ", 0, 1),
    ("s = \"open // text\n", "s = \"open // text\n", 0, 0),
    ("a / b / c", "a / b / c", 0, 0),
    ("a // x /* y\n b */", "a \n b */", 1, 8),
    ("a /* // */ b // */", "a  b ", 0, 9),
    ("", "", 0, 0),
)


@pytest.mark.parametrize("case", COMMENT_CASES)
def test_comments_are_cut_and_counted(case):
    source, *want = case
    assert X.comment_parts(source) == tuple(want)


def test_comment_cutting_keeps_lines_and_is_stable():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("/*\"'\\\nab ") for _ in range(rng.randint(0, 24)))
        bare, lines, chars = X.comment_parts(text)
        assert bare.count("\n") == text.count("\n") and lines <= bare.count("\n") and len(bare) + chars >= len(text) - 2 * text.count("/")


def test_rare_overlap_falls_back_to_all_keys(spark):
    rows = [("expr", s, f, w) for s, fs in {"a": {"x": 2.0, "y": 1.0}, "b": {"x": 1.0, "y": 1.0}, "c": {"k:x": 3.0, "x": 2.0}, "d": {"k:x": 1.0, "x": 5.0}}.items() for f, w in fs.items()]
    got = {r.i + r.j: r.rare_overlap for r in S.rare_overlaps(spark.createDataFrame(rows, "space string, sid string, feature string, w double")).collect()}
    assert got == {"ab": 2 / 3, "ac": 1.0, "ad": 2 / 5, "bc": 0.5, "bd": 1 / 5, "cd": 1 / 3}


def test_masks_and_chunks(spark):
    df = spark.createDataFrame([("int x = foo(\"a b\", 12); Verä _y2 3a None",)], "t string")
    row = df.select(X.mask_identifiers(F.col("t")).alias("i"), X.mask_literals(F.col("t")).alias("l"), X.slugify(F.lit(" a b/c ")).alias("s"), X.packed_chunks(F.lit("aa\nbb\ncccccccc\ndd"), 6).alias("c")).first()
    assert row.i == 'int ID = ID("ID ID", 12); Verä ID 3a None'
    assert row.l == "int x = foo(STR, NUM); Verä _y2 3a None"
    assert row.s == "a_b_c" and row.c == ["aa\nbb", "cccccccc", "dd"]


def test_six_normal_forms(spark):
    df = spark.createDataFrame([("int  x = 12; // note\n\ty(\"a b\");\n",)], "t string").withColumn("c", X.strip_comments(F.col("t")))
    row = df.select(*[v.alias(k) for k, v in X.normalizations(F.col("t"), F.col("c.text")).items()]).first().asDict()
    assert row == {
        "raw": "int  x = 12; // note\n\ty(\"a b\");\n", "whitespace": "int x = 12; // note\ny(\"a b\");", "no_comments": "int x = 12;\ny(\"a b\");",
        "masked_identifiers": "int ID = 12;\nID(\"ID ID\");", "masked_literals": "int x = NUM;\ny(STR);", "ast_normalized": "int ID = NUM;\nID(STR);",
    }


def test_source_features_of_code(spark):
    code = "import java.util.List;\nclass A {\n  int f(int n) { if (n > 1) { return n; } return g(n); } // c\n}\n"
    df = spark.createDataFrame([(1, "s", code), (2, "s", None), (3, "s", "")], "file_id int, sid string, text string")
    got = {(r.file_id, r.feature): r.value for r in T.file_features(df).collect()}
    assert got[1, "import_family:java.util"] == 1.0 and got[1, "keyword:return"] == 2.0 and got[1, "call_name:g"] == 1.0
    assert any(k[1].startswith("line_skeleton:") for k in got) and any(k[1].startswith("keyword_operator_pair:") for k in got)
    assert got[2, "token_count"] == got[3, "token_count"] == 0.0
    agg = {r.feature: r.value for r in M.aggregate_features(T.file_features(df)).filter("space = 'expr'").collect()}
    assert agg["file_count"] == 3.0


def test_feature_rules(spark):
    keys = {"import_family:x": "binary", "line_bucket:short_ratio": "ratio", "call_name:get_mean": "ratio", "a_per_b": "ratio", "token_count": "count"}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.v for r in df.withColumn("v", FF.feature_kind(F.col("k"))).collect()} == keys
    labels = {"expr_ngram:2:a:b": "maskiertes Token-2-Gramm 'a:b'", "operator:logic": "logische Operatoren", "token_count": "token count", "ast_path:a>b": "AST-Pfad a>b"}
    df = spark.createDataFrame([(k,) for k in labels], "k string")
    assert {r.k: r.v for r in df.withColumn("v", FF.humanize_feature(F.col("k"))).collect()} == labels


def test_block_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(90)] + [(900, None)]
    monkeypatch.setattr(search, "ROW_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(r.id, r["rank"]): r.neighbor for r in search.block_topk(df.filter("id % 5 = 0"), df, 3).collect()}
    want = {}
    for i, v in rows[:90:5]:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows[:90] if j != i)[:3]
        want |= {(i, r + 1): j for r, (_, j) in enumerate(best)}
    assert got == want


def test_cache_states_and_unique_ids(spark):
    asked = spark.createDataFrame([("m", "h1"), ("m", "h1"), ("m", "h2"), ("m", "h3"), ("n", "h1")], "model string, text_sha256 string")
    cache = spark.createDataFrame([("m", "h1", 2, [1.0, 2.0]), ("m", "h2", 2, [1.0]), ("m", "h3", 1, [float("nan")])], "model string, text_sha256 string, dimension int, vector array<double>")
    c = {r.model: r for r in R.cache_counters(R.cache_lookup(asked, cache)).collect()}
    assert (c["m"].hits, c["m"].stale, c["m"].misses, c["n"].misses) == (2, 2, 0, 1)
    assert R.cache_counters(R.cache_lookup(asked, cache, force=True)).agg(F.sum("bypassed")).first()[0] == 5
    assert R.cache_missing(asked, cache).count() == 1
    ids = R.unique_ids(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "c string, o int"), "c", "o")
    assert sorted(r.submission_id for r in ids.collect()) == ["x", "x_2", "y"]
    ids = R.unique_ids(spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("x_2", 4), ("x_4", 5)], "c string, o int"), "c", "o")
    assert sorted(r.submission_id for r in ids.collect()) == ["x", "x_2", "x_3", "x_4", "x_5"]


def test_submission_features_hold_every_feature_of_every_file(spark, tmp_path):
    from kinmesh.plans import text as P

    rows = [(1, "return x + y ;\nreturn x + y ;\n", "a"), (2, "return u + v ;\nint k = 2 ;\n", "a"), (3, "import java.util.List;\nwhile (a) { b(); }\n", "b"), (4, None, "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    files = T.file_features(P.files(spark, str(tmp_path))).withColumn("kind", FF.feature_kind(F.col("feature"))).collect()
    held, names = {}, {}
    for r in files:
        held.setdefault((r.space, r.sid, r.feature, r.kind), []).append(r.value)
        names.setdefault((r.space, r.sid), set()).add(r.file_id)
    brute = {"binary": lambda v: float(max(v) > 0), "ratio": lambda v: sum(v) / len(v)}
    want = {k[:3]: round(brute.get(k[3], sum)(v), 4) for k, v in held.items()} | {(*k, "file_count"): float(len(v)) for k, v in names.items()}
    got = {(r.space, r.sid, r.feature): r.value for r in P.submission_features(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    skeletons = {k[2]: v for k, v in got.items() if k[1] == "a" and k[2].startswith("line_skeleton:return")}
    assert list(skeletons.values()) == [3.0]  # two lines of one file and one of another
    assert any(k[2].startswith("expr_ngram:3:") for k in got)


def test_vector_pairs_are_all_cosines_of_the_queries(spark, tmp_path):
    from kinmesh.plans import dense as P

    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(q, k): max(0.0, dot(held[q], v) / (dot(held[q], held[q]) * dot(v, v)) ** 0.5) for q in (0, 50, 100) for k, v in held.items() if k != q}
    got = P.dense_vector_pairs(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and all(abs(want[r.id, r.neighbor] - r.similarity) < 2e-5 for r in got)


def test_cache_text_counters_hit_equal_texts_only(spark, tmp_path):
    from kinmesh.plans import runs as P

    rows = [(12, "one", "s", 3), (2, "one", "s", 3), (4, "two", "s", 3), (18, "six", "s", 3), (8, "six", "s", 3), (10, None, "s", 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = P.cache_text_counters(spark, str(tmp_path)).collect()
    assert (r.model, r.requests, r.hits, r.misses, r.stale) == ("m0", 6, 2, 2, 2)


def test_similar_sources_are_fused_first(spark):
    from kinmesh.operators import struct_features as ST
    from kinmesh.session import materialize

    a = "import java.util.List;\nclass A {\n  int sum(List<Integer> xs) { int s = 0; for (int x : xs) { if (x > 0) { s += x; } } return s; }\n}\n"
    c = "class C {\n  void run() { while (true) { try { System.out.println(\"go\"); } catch (Exception e) { throw new RuntimeException(e); } } }\n  C() { run(); }\n}\n"
    files = spark.createDataFrame([("a", 1, a), ("b", 2, a.replace("sum", "total").replace("xs", "values")), ("c", 3, c), ("d", 4, "class D { int x = ; }"), ("d", 5, None)], "sid string, file_id int, text string")
    tree = materialize(ST.syntax_nodes(files))
    struct = ST.struct_features(tree)
    by_file = {}
    for r in struct.collect():
        by_file.setdefault(r.file_id, {})[r.feature] = r.value
    one = by_file["1"]
    assert one["ast_node_count"] > 0 and one["ast_max_depth"] >= 3 and one["ast_node:method"] >= 1 and one["ast_node:if"] >= 1 and one["ast_parse_status:ok"] == 1.0
    assert any(k.startswith("ast_path:") for k in one) and one["ast_edge:method->block"] == 1.0 and one["ast_method_arity:1"] == 1.0 and one["ast_method_statement:3_5"] == 1.0
    assert abs(sum(v for k, v in one.items() if k.startswith("ast_node_ratio:")) - 1) < 1e-9
    assert by_file["4"]["ast_parse_status:recovered"] == 1.0 and by_file["4"]["ast_error_ratio"] > 0 and by_file["5"]["ast_node_count"] == 1.0
    text = T.file_features(files).withColumn("file_id", F.col("file_id").cast("string"))
    long = materialize(M.aggregate_features(text.unionByName(struct)))
    w = materialize(M.weighted_features(long, M.feature_stats(long)))
    pairs = materialize(S.calibrate(S.hybrid(S.pair_components(w))))
    fused = {r.i + r.j: r.raw for r in S.fuse(pairs).collect()}
    assert len(fused) == 6 and max(fused, key=fused.get) == "ab"


def test_grams_are_counted_where_the_file_lies(spark):
    from kinmesh.operators.text_features import top_grams

    df = spark.createDataFrame([(1, ["b", "a", "b", "a", "c"]), (2, ["x"]), (3, None), (4, ["q", "r"]), (4, ["s", "t", "q", "r"]), (None, ["u", "v"])], "file_id int, tokens array<string>")
    rows = top_grams(df, 2, 2)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, 1, "b a", 2), (1, 2, "a b", 1), (4, 1, "q r", 2), (4, 2, "s t", 1), (None, 1, "u v", 1)], key=str)
    plan = top_grams(df.filter("file_id < 4"), 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_all_products_of_a_set_come_once_and_without_a_shuffle(spark, monkeypatch):
    from kinmesh.operators import search

    monkeypatch.setattr(search, "OWN_BLOCK", 8)
    x = np.random.default_rng(2).normal(size=(50, 6))
    out = search.own_products(spark.createDataFrame([(k * 3, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>"))
    got = {(r.i, r.j): r.similarity for r in out.collect()}
    assert len(got) == out.count() == 50 * 49 // 2
    assert all(i < j and abs(s - x[i // 3] @ x[j // 3]) < 1e-12 for (i, j), s in got.items())
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_grams_and_words_of_a_text_in_one_trip_equal_the_plain_counts(spark):
    texts = ["", "aaaa List ArrayList", "a b a b c", "é stream", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.split("t", " "))
    needles = ("List", "ArrayList", "aa", "stream")
    one = X.top_grams(F.col("w"), {2: 2, 3: 9})
    for r in df.select(one["g2"].alias("a"), X.top_counts(X.grams(F.col("w"), 2), 2).alias("b"), one["g3"].alias("c"), X.top_counts(X.grams(F.col("w"), 3), 9).alias("d"),
                       X.count_substrings(F.col("t"), needles).alias("e"), F.array(*[X.count_substring(F.col("t"), n) for n in needles]).alias("f")).collect():
        assert r.a == r.b and r.c == r.d and r.e == r.f


def test_chosen_neighbours_are_those_above_the_local_floors(spark):
    import random

    rng = random.Random(6)
    rows = [(s, i, j, v, v) for s, n in (("a", 40), ("b", 9), ("c", 20), ("d", 3)) for i in range(n) for j in range(i + 1, n) for v in [round(rng.choice([rng.random(), 0.5]), 2)]]
    pairs = spark.createDataFrame(rows, "space string, i bigint, j bigint, raw double, cal double")
    want = N.adaptive_topk(pairs).drop("local_floor").collect()
    assert sorted(N.chosen_topk(pairs).collect()) == sorted(want)


def test_parts_of_a_pair_table_keep_every_edge_of_its_tree(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n = 60
    rows = [("s", int(i), int(j), float(rng.integers(1, 9)) / 8) for i in range(n) for j in range(i + 1, n)]
    group, want = list(range(n)), []

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for _, i, j, w in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if root(i) != root(j):
            group[root(i)] = root(j)
            want.append((i, j, w))
    flat = pa.table({"space": ["s"] * len(rows), **{c: [r[k] for r in rows] for k, c in ((1, "i"), (2, "j"), (3, "reach"))}})
    assert sorted(zip(*(D.forest(flat)[c].to_pylist() for c in ("i", "j", "reach")), strict=True)) == sorted(want)
    reach = spark.createDataFrame([*rows, ("t", 1, 2, 0.5)], "space string, i bigint, j bigint, reach double").repartition(3)
    left = D.forests(reach)
    assert left.filter("space = 's'").count() <= 3 * (n - 1)
    nodes_ = spark.createDataFrame([("s", k) for k in range(n)] + [("t", 1), ("t", 2), ("t", 3)], "space string, sid bigint")
    assert sorted((r.i, r.j, r.reach) for r in D.spanning_trees(nodes_, reach).collect() if r.space == "s") == sorted(want)


def test_block_pairs_are_not_broadcast(spark, monkeypatch):
    from kinmesh.operators import blocked

    plans, pairs = [], blocked._pairs

    def spied(*args):
        plans.append(pairs(*args))
        return plans[-1]

    monkeypatch.setattr(blocked, "_pairs", spied)
    long = spark.createDataFrame([("expr", k, f"f:{(k * m) % 5}", float(k % 4 + m)) for k in range(12) for m in (1, 2)], "space string, sid bigint, feature string, value double").groupBy("space", "sid", "feature").agg(F.sum("value").alias("value"))
    weighted = M.weighted_features(long, M.feature_stats(long))
    got = {(r.i, r.j): r for r in blocked.block_components(weighted, sids=3, features=2).collect()}
    want = S.pair_components(weighted).collect()
    assert len(got) == len(want) == 66
    for r in want:
        assert tuple(got[r.i, r.j])[3:] == pytest.approx(tuple(r)[3:], abs=1e-9)
    assert len(plans) == 2 and not any("BroadcastExchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_counts_of_a_text_in_one_trip_equal_the_column_functions(spark):
    texts = [
        "", "\n", "a b a b c\n\n  x  y \r\nlast", "int f(int n) { if (n >= 1 && m != 2) { return \"a b\" + g(n) + 'c' + 12.5; } // note\n/* one\ntwo */ return 3ab; }\nclass Point { Point(int x) throws E { } }\n",
        "import java.util.List;\n import a.b.* ;\nnew ArrayList<>().add(List.of(1, 2)).put (3); new_one NEW aB snake_case X _y größe naïve (été)\n", "for " * 40 + "while (x) y++ " * 60, "a\"b\" 1.2.3 def \"open if\nx<<=y>>>z&&!w|v^~u%=t",
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "file_id int, text string")
    code, t = X.strip_comments(F.col("text"))["text"], F.col("text")
    masked = X.mask_identifiers(X.mask_literals(code))
    words = F.filter(X.tokenize(masked), lambda w: w.rlike(rf"^{X.IDENTIFIER}$"))
    tokens, ids = X.tokenize(code), X.identifiers(code)
    plain = {
        "tokens": F.size(tokens), "unique": F.size(F.array_distinct(tokens)), "ids": F.size(ids), "chars": F.length(t),
        "words": F.transform(X.top_counts(words), lambda e: e["n"]), "lengths": X.top_counts(F.transform(X.non_empty_lines(t), lambda x: F.length(x))),
        "g2": X.top_counts(X.grams(words, 2), 36), "g3": X.top_counts(X.grams(words, 3), 24), "calls": T.call_names(code, 16),
        "skeletons": T.line_skeletons(masked, 28), "pairs": T.keyword_operator_pairs(tokens, 20),
        "signs": F.array(*[F.regexp_count(code, F.lit(p)) for p in X.OPERATORS.values()]), "inside": F.array(*[X.count_substring(code, n) for n in X.NEEDLES]),
        "found": F.array(*[F.regexp_count(code, F.lit(rf"(?U)\b{w}\b")) for w in X.WORDS]), "called": F.array(*[F.regexp_count(code, F.lit(rf"(?U)\b{w}\s*\(")) for w in X.CALLS]),
        "declared": F.array(F.regexp_count(code, F.lit(X.METHOD)), F.regexp_count(code, F.lit(X.CONSTRUCTOR))), "imports": F.regexp_extract_all(code, F.lit(X.IMPORT), F.lit(1)),
    }
    shares = T.identifier_shapes(ids) | {k: v for k, v in T.token_categories(tokens).items() if "punctuation" not in k}
    rows = df.select(X.counted(t).alias("c"), F.struct(*[v.alias(k) for k, v in plain.items()]).alias("p"), F.array(*shares.values()).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: r.c[k] for k in plain} == r.p.asDict()
        assert r.s == [n / max(1, r.c.ids) for n in r.c.shapes] + [n / max(1, r.c.tokens) for n in r.c.categories]
    assert rows[3].c.declared[0] and rows[4].c.imports == ["java.util.List", "a.b.*"] and rows[3].c.comment_lines


def test_features_of_submissions_are_made_once(spark, sf):
    from kinmesh.plans import text as P

    for query in (P.submission_features, P.text_features):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("ArrowEvalPython") == 1
