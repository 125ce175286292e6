"""Queries of cohort and graph reports, on the points and graphs of the other plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.operators import cohorts as H
from kinmesh.operators import reports as R
from kinmesh.plans import basket, dense
from kinmesh.session import read_table


def year_cluster_grid(spark, sf_dir):
    out = R.year_cluster_grid(dense.points(spark, sf_dir))
    return out.select("lab", "year", "cluster", "n", F.round("share", 5).alias("share"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def cluster_statuses(spark, sf_dir):
    p = dense.points(spark, sf_dir)
    return R.cluster_statuses(H.cluster_artifacts(p), p).select("lab", "cluster", "status")


def cohort_overview(spark, sf_dir):
    return R.overview(dense.scored(spark, sf_dir))


def year_shapes(spark, sf_dir):
    return R.year_shapes(dense.points(spark, sf_dir))


def point_positions(spark, sf_dir):
    return R.scaled(dense.points(spark, sf_dir), "lab").select("lab", "id", F.round("sx", 5).alias("sx"), F.round("sy", 5).alias("sy"))


def weighted_mean_vectors(spark, sf_dir):
    """Mean vector of each label, a row weighing the root of its id and 1 at least; told by dimension."""
    rows = dense.vectors(spark, sf_dir).select("label", F.col("vec_id").alias("place"), "v", F.greatest(F.lit(1.0), F.sqrt("vec_id")).alias("weight"))
    return R.weighted_means(rows, "label").select("label", F.posexplode("centroid").alias("d", "m")).select("label", "d", F.round("m", 5).alias("m"))


def point_search(spark, sf_dir):
    """Points of 2016 and 2018 in which id, year or cluster reads like 18."""
    chosen = R.selected(dense.points(spark, sf_dir), years=[2016, 2018])
    return R.found_by(chosen, " 18", "id", "year", "cluster").select("lab", "id", "year", "cluster")


def workspace_overview(spark, sf_dir):
    """Nations as labs, their customers' filled orders as published runs, the lines as artefacts; three parts are required."""
    labs = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lab"))
    runs = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("lab"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    parts = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("name"))
    return R.workspace(labs, runs, parts, 3)


def _workspace(spark, sf_dir):
    """Customers as labs, filled orders as published runs of a model by priority, line numbers as artefacts by name."""
    names = F.array(*map(F.lit, ("overview", "year_stats", "year_similarity", "clusters", "projection", "neighbors", "vectors")))
    labs = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lab"))
    o = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    runs = o.select(F.col("o_custkey").alias("lab"), F.col("o_orderkey").alias("run_id"), F.concat(F.lit("m"), (F.col("o_orderkey") % 2).cast("string")).alias("model"), F.col("o_orderdate").alias("created_at"))
    line = read_table(spark, sf_dir, "lineitem")
    parts = line.select(F.col("l_orderkey").alias("run_id"), F.element_at(names, F.pmod(F.col("l_partkey"), F.lit(7)).cast("int") + 1).alias("name"))
    points = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lab"), F.year("o_orderdate").alias("year"))
    return labs, runs, parts, points


def workspace_runs(spark, sf_dir):
    labs, runs, parts, _ = _workspace(spark, sf_dir)
    out = R.workspace_runs(labs, runs, parts, "m1")
    return out.select("lab", "run_id", "state", "reason", F.array_join("lacking", ",").alias("lacking"))


def workspace_totals(spark, sf_dir):
    labs, runs, parts, points = _workspace(spark, sf_dir)
    out = R.workspace_totals(R.workspace_runs(labs, runs, parts), points)
    return out.select("labs", "missing", "submissions", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.array_join("transitions", ",").alias("transitions"))


def cohort_cluster_spread(spark, sf_dir):
    out = H.cluster_spread(dense.points(spark, sf_dir))
    told = F.array_join(F.transform(F.map_entries("by_year"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("by_year")
    return out.select("lab", "cluster", told, F.array_join(F.col("exemplars").cast("array<string>"), ",").alias("exemplars"))


def cohort_year_spread(spark, sf_dir):
    out = H.year_spread(dense.points(spark, sf_dir))
    return out.select("lab", "year", F.array_join(F.transform(F.map_entries("by_cluster"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("by_cluster"))


def cluster_edge_groups(spark, sf_dir):
    _, _, edges, members = basket._clustered(spark, sf_dir)
    return R.cluster_edges(members, edges)


def name_keys(spark, sf_dir):
    """Year and key read from made-up file names of parts."""
    part = read_table(spark, sf_dir, "part")
    name = F.concat(F.col("p_name"), F.lit("_Jahrgang "), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit("_Abgabe-p"), F.col("p_partkey").cast("string"), F.lit(".ZIP"))
    return part.select("p_partkey", R.year_of_name(name).alias("year"), R.key_of_name(name).alias("key"), R.natural_key(F.col("p_brand")).alias("sort_key"))


_P = dense._POINTS
SQL = {
    "year_cluster_grid": f"""WITH {_P}, g AS (SELECT * FROM (SELECT DISTINCT lab, year FROM pt) JOIN (SELECT DISTINCT lab, cluster FROM pt) USING (lab)),
  c AS (SELECT g.lab, g.year, g.cluster, count(id) AS n, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS members FROM g LEFT JOIN pt ON pt.lab = g.lab AND pt.year = g.year AND pt.cluster = g.cluster GROUP BY g.lab, g.year, g.cluster)
  SELECT lab, year, cluster, n, round(n / sum(n) OVER (PARTITION BY lab, year), 5) AS share, members FROM c""",
    "cluster_statuses": f"""WITH {_P}, s AS (SELECT lab, min(year) AS f, max(year) AS l FROM pt GROUP BY lab), b AS (SELECT lab, cluster, year, count(*) AS n FROM pt GROUP BY ALL),
  a AS (SELECT lab, cluster, f, l, min(year) AS fy, max(n) AS peak, coalesce(sum(n) FILTER (WHERE year = l), 0) AS last, count(*) AS years FROM b JOIN s USING (lab) GROUP BY ALL)
  SELECT lab, cluster, CASE WHEN cluster < 0 THEN 'mixed' WHEN fy > f THEN 'new' WHEN peak > 0 AND last <= peak // 3 AND l <> fy THEN 'declining' WHEN years >= 3 THEN 'stable' ELSE 'mixed' END AS status FROM a""",
    "cohort_overview": f"""WITH {dense._OUT} SELECT lab, count(*) AS points, count(DISTINCT year) AS years, count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS clusters, count(*) FILTER (WHERE outlier >= 0.9) AS outliers, min(year) AS first_year, max(year) AS last_year FROM sc GROUP BY lab""",
    "year_shapes": f"WITH {_P} SELECT lab, year, ((row_number() OVER (PARTITION BY lab ORDER BY year) - 1) % 8)::INT AS shape FROM (SELECT DISTINCT lab, year FROM pt)",
    "point_positions": f"""WITH {_P}, b AS (SELECT lab, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY lab)
  SELECT lab, id, round((x - (x0 - 0.08 * (x1 - x0))) / ((x1 - x0) * 1.16), 5) AS sx, round((y - (y0 - 0.08 * (y1 - y0))) / ((y1 - y0) * 1.16), 5) AS sy FROM pt JOIN b USING (lab)""",
    "weighted_mean_vectors": """WITH e AS (SELECT label, greatest(1.0, sqrt(vec_id)) AS w, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS d FROM embeddings)
  SELECT label, d, round(sum(x * w) / sum(w), 5) AS m FROM e GROUP BY ALL""",
    "point_search": f"WITH {_P} SELECT lab, id, year, cluster FROM pt WHERE year IN (2016, 2018) AND (contains(id::VARCHAR, '18') OR contains(year::VARCHAR, '18') OR contains(cluster::VARCHAR, '18'))",
    "workspace_overview": """WITH r AS (SELECT o_custkey AS lab, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F'),
  h AS (SELECT l_orderkey AS run_id, count(DISTINCT l_partkey) AS have FROM lineitem GROUP BY ALL)
  SELECT c_custkey AS lab, r.run_id, CASE WHEN coalesce(have, 0) >= 3 THEN 'ready' ELSE 'missing' END AS state, CASE WHEN r.run_id IS NULL THEN 'no_published_run' WHEN coalesce(have, 0) < 3 THEN 'incomplete_artifacts' END AS reason
  FROM customer LEFT JOIN r ON r.lab = c_custkey AND rn = 1 LEFT JOIN h ON h.run_id = r.run_id""",
    "workspace_runs": """WITH r AS (SELECT o_custkey AS lab, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1),
  h AS (SELECT l_orderkey AS run_id, concat_ws(',', CASE WHEN NOT bool_or(l_partkey % 7 = 0) THEN 'overview' END, CASE WHEN NOT bool_or(l_partkey % 7 = 1) THEN 'year_stats' END, CASE WHEN NOT bool_or(l_partkey % 7 = 2) THEN 'year_similarity' END) AS lacking FROM lineitem GROUP BY l_orderkey),
  j AS (SELECT c_custkey AS lab, r.run_id, CASE WHEN r.run_id IS NOT NULL THEN coalesce(lacking, 'overview,year_stats,year_similarity') END AS lacking FROM customer LEFT JOIN r ON r.lab = c_custkey AND rn = 1 LEFT JOIN h ON h.run_id = r.run_id)
  SELECT lab, run_id, CASE WHEN lacking = '' THEN 'ready' ELSE 'missing' END AS state, CASE WHEN run_id IS NULL THEN 'no_published_run_for_model' WHEN lacking <> '' THEN 'published_run_without_complete_artifacts' END AS reason, lacking FROM j""",
    "workspace_totals": """WITH r AS (SELECT o_custkey AS lab, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F'),
  h AS (SELECT l_orderkey AS run_id, count(DISTINCT l_partkey % 7) AS have FROM lineitem WHERE l_partkey % 7 < 3 GROUP BY l_orderkey),
  s AS (SELECT c_custkey AS lab, coalesce(have, 0) = 3 AS ready FROM customer LEFT JOIN r ON r.lab = c_custkey AND rn = 1 LEFT JOIN h ON h.run_id = r.run_id),
  y AS (SELECT o_custkey AS lab, year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_custkey IN (SELECT lab FROM s WHERE ready) GROUP BY ALL),
  m AS (SELECT *, year || '-' || lead(year) OVER (PARTITION BY lab ORDER BY year) AS move FROM y)
  SELECT (SELECT count(*) FROM s WHERE ready) AS labs, (SELECT count(*) FROM s WHERE NOT ready) AS missing, coalesce(sum(n), 0)::BIGINT AS submissions,
    coalesce(string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR), '') AS years, coalesce(string_agg(DISTINCT move, ',' ORDER BY move), '') AS transitions FROM m""",
    "cohort_cluster_spread": f"""WITH {_P}, g AS (SELECT * FROM (SELECT DISTINCT lab, cluster FROM pt) JOIN (SELECT DISTINCT lab, year FROM pt) USING (lab)),
  c AS (SELECT g.lab, g.cluster, g.year, count(id) AS n FROM g LEFT JOIN pt ON pt.lab = g.lab AND pt.year = g.year AND pt.cluster = g.cluster GROUP BY ALL),
  x AS (SELECT lab, cluster, string_agg(id::VARCHAR, ',' ORDER BY id) AS exemplars FROM (SELECT *, row_number() OVER (PARTITION BY lab, cluster ORDER BY id) AS rn FROM pt) WHERE rn <= 3 GROUP BY ALL)
  SELECT lab, cluster, string_agg(year || '=' || n, ',' ORDER BY year) AS by_year, any_value(exemplars) AS exemplars FROM c JOIN x USING (lab, cluster) GROUP BY lab, cluster""",
    "cohort_year_spread": f"""WITH {_P}, g AS (SELECT * FROM (SELECT DISTINCT lab, cluster FROM pt) JOIN (SELECT DISTINCT lab, year FROM pt) USING (lab)),
  c AS (SELECT g.lab, g.cluster, g.year, count(id) AS n FROM g LEFT JOIN pt ON pt.lab = g.lab AND pt.year = g.year AND pt.cluster = g.cluster GROUP BY ALL)
  SELECT lab, year, string_agg(cluster || '=' || n, ',' ORDER BY cluster) AS by_cluster FROM c GROUP BY lab, year""",
    "cluster_edge_groups": f"""WITH RECURSIVE {basket._CLUSTERS}, n AS (SELECT space, cluster, count(*) AS nodes FROM mem GROUP BY ALL),
  ec AS (SELECT e.space, a.cluster AS ci, b.cluster AS cj FROM e JOIN mem a ON a.space = e.space AND a.sid = e.i JOIN mem b ON b.space = e.space AND b.sid = e.j)
  SELECT n.space, n.cluster, n.nodes, (SELECT count(*) FROM ec WHERE ec.space = n.space AND ci IS NOT DISTINCT FROM n.cluster AND cj IS NOT DISTINCT FROM n.cluster) AS internal,
    (SELECT count(*) FROM ec WHERE ec.space = n.space AND (ci IS NOT DISTINCT FROM n.cluster) <> (cj IS NOT DISTINCT FROM n.cluster)) AS external FROM n""",
    "name_keys": r"""SELECT p_partkey, 1990 + p_size AS year, regexp_replace(regexp_replace(lower(p_name) || '_jahrgang_abgabe_p' || p_partkey, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key,
  regexp_replace(p_brand, '[0-9]+$', '') || lpad(regexp_extract(p_brand, '[0-9]+$'), 20, '0') AS sort_key FROM part""",
}
QUERIES = {name: globals()[name] for name in SQL}
