"""Queries on dense vectors: search, cohorts, drift, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.functions.vectors import cosine, normalized
from kinmesh.operators import cohorts as H
from kinmesh.operators.search import block_products, block_topk
from kinmesh.session import materialize, read_table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v) with v as doubles."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort points: lab = vec_id mod 3, year = 2015 + label, cluster = vec_id mod 5 less 1 (-1 is noise), x and y the first two dimensions."""
    df = vectors(spark, sf_dir)
    return df.select(
        (F.col("vec_id") % 3).cast("int").alias("lab"), (F.col("label") + 2015).cast("int").alias("year"), F.col("vec_id").alias("id"), "v",
        F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), ((F.col("vec_id") % 5) - 1).cast("int").alias("cluster"),
    )


def scored(spark, sf_dir):
    return materialize(H.outlier_scores(points(spark, sf_dir)), "points")


def dense_topk_neighbors(spark, sf_dir):
    """The 6 nearest rows by cosine for every row whose id is divisible by 50, against all rows."""
    df = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), normalized(F.col("v")).alias("v"))
    return block_topk(df.filter(F.col("id") % 50 == 0), df, 6).select("id", "neighbor", "rank", F.round("similarity", 5).alias("similarity"))


def dense_pair_cosine(spark, sf_dir):
    """Cosines between the label centroids and the rows of ids divisible by 50, as its SQL states; pairs of vectors are in dense_vector_pairs."""
    df = vectors(spark, sf_dir)
    c = H.centroids(df, "label").select(F.col("label").alias("other"), normalized(F.col("centroid")).alias("u"))
    table = c.agg(F.sort_array(F.collect_list(F.struct("other", "u"))).alias("cs"))  # one row: a centroid a label
    rows = df.filter(F.col("vec_id") % 50 == 0).join(F.broadcast(table))
    return rows.select("vec_id", "label", F.explode("cs").alias("c"), "v").select("vec_id", "label", F.col("c.other").alias("other"), F.round(F.greatest(F.lit(0.0), cosine(F.col("v"), F.col("c.u"))), 5).alias("similarity"))


def dense_vector_pairs(spark, sf_dir):
    """The cosine, 0 at least, of every row whose id is divisible by 50 with every other row. A search: all of its pairs are returned."""
    df = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), normalized(F.col("v")).alias("v"))
    out = block_products(df.filter(F.col("id") % 50 == 0), df)
    return out.select("id", "neighbor", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")), 5).alias("similarity"))


def cohort_centroid_similarity(spark, sf_dir):
    return H.year_similarity(points(spark, sf_dir))  # six places: rounding them again would meet ties


def cohort_year_stats(spark, sf_dir):
    return H.year_stats(scored(spark, sf_dir)).select("lab", "year", "n", "outliers", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"))


def cohort_cluster_artifacts(spark, sf_dir):
    out = H.cluster_artifacts(points(spark, sf_dir))
    return out.withColumns({"cx": F.round("cx", 5), "cy": F.round("cy", 5)})


def _moves(spark, sf_dir):
    p = scored(spark, sf_dir)
    return H.transitions(H.year_stats(p), H.year_similarity(p))


def cohort_transitions(spark, sf_dir):
    return _moves(spark, sf_dir).select("lab", "year", "next_year", "similarity", *[F.round(c, 6).alias(c) for c in ("dx", "dy")], *[F.round(c, 5).alias(c) for c in ("distance", "share")])


def cohort_drift_summary(spark, sf_dir):
    out = H.drift_summary(_moves(spark, sf_dir))
    return out.select("lab", "max_jump_year", F.round("mean_similarity", 9).alias("mean_similarity"), *[F.round(c, 5).alias(c) for c in ("path_length", "max_jump", "total_drift")])


def outlier_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("lab", "id", "cluster", F.round("outlier", 5).alias("outlier"))


def nearest_centroid_assign(spark, sf_dir):
    return H.nearest_centroid(points(spark, sf_dir)).select("lab", "id", "cluster")


def year_cluster_cube(spark, sf_dir):
    """Counts by lab, year, cluster with all totals; level tells which keys are summed over."""
    return points(spark, sf_dir).cube("lab", "year", "cluster").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


_UNIT = "u AS (SELECT vec_id AS id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"
_POINTS = """pt AS (SELECT (vec_id % 3)::INT AS lab, (label + 2015)::INT AS year, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, ((vec_id % 5) - 1)::INT AS cluster FROM embeddings)"""


def _centroid(name: str, source: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"""{name}_m AS (SELECT {k}, d, avg(x) AS m FROM (SELECT {k}, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {source}) GROUP BY {k}, d),
{name}_c AS (SELECT {k}, list(m ORDER BY d) AS c FROM {name}_m GROUP BY {k}),
{name} AS (SELECT {k}, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM {name}_c)"""


_COS = "greatest(-1, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
_OUT = f"""{_POINTS}, {_centroid('cc', '(SELECT * FROM pt WHERE cluster >= 0)', 'lab', 'cluster')},
dd AS (SELECT pt.*, CASE WHEN pt.cluster < 0 THEN 1.0 ELSE greatest(0, 1 - {_COS.format(a='pt.v', b='cc.u')}) END AS d FROM pt LEFT JOIN cc ON cc.lab = pt.lab AND cc.cluster = pt.cluster),
dq AS (SELECT lab, quantile_cont(d, 0.5) AS lo, quantile_cont(d, 0.95) AS hi FROM dd GROUP BY lab),
sc AS (SELECT dd.*, least(1, greatest(0, (d - lo) / (hi - lo))) AS outlier FROM dd JOIN dq USING (lab))"""
_SIM = f"{_centroid('yc', 'pt', 'lab', 'year')}, ys AS (SELECT a.lab, a.year AS year_a, b.year AS year_b, round({_COS.format(a='a.u', b='b.u')}, 6) AS similarity FROM yc a JOIN yc b ON a.lab = b.lab)"
_MOVES = f"""{_OUT}, {_SIM}, st AS (SELECT lab, year, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM sc GROUP BY ALL),
ld AS (SELECT lab, year, lead(year) OVER w AS next_year, lead(cx) OVER w - cx AS dx, lead(cy) OVER w - cy AS dy FROM st WINDOW w AS (PARTITION BY lab ORDER BY year)),
mv AS (SELECT ld.*, sqrt(dx * dx + dy * dy) AS distance, coalesce(sqrt(dx * dx + dy * dy) / nullif(max(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY lab), 0), 0) AS share FROM ld WHERE next_year IS NOT NULL),
tr AS (SELECT mv.*, similarity FROM mv LEFT JOIN ys ON ys.lab = mv.lab AND year_a = year AND year_b = next_year)"""

SQL = {
    "dense_topk_neighbors": f"""WITH {_UNIT}, s AS (SELECT q.id, b.id AS neighbor, list_dot_product(q.v, b.v) AS s FROM u q JOIN u b ON q.id <> b.id WHERE q.id % 50 = 0)
  SELECT id, neighbor, rank::INT AS rank, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbor) AS rank FROM s) WHERE rank <= 6""",
    "dense_pair_cosine": f"""WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), {_centroid('lc', 's', 'label')}
  SELECT vec_id, s.label, lc.label AS other, round(greatest(0, {_COS.format(a='v', b='u')}), 5) AS similarity FROM s, lc WHERE vec_id % 50 = 0""",
    "cohort_centroid_similarity": f"WITH {_POINTS}, {_SIM} SELECT lab, year_a, year_b, similarity FROM ys",
    "cohort_year_stats": f"WITH {_OUT} SELECT lab, year, count(*) AS n, count(*) FILTER (WHERE outlier >= 0.9) AS outliers, round(avg(x), 5) AS cx, round(avg(y), 5) AS cy FROM sc GROUP BY ALL",
    "cohort_cluster_artifacts": f"""WITH {_POINTS}, b AS (SELECT lab, cluster, year, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM pt GROUP BY ALL),
  s AS (SELECT lab, min(year) AS f, max(year) AS l FROM pt GROUP BY lab),
  a AS (SELECT lab, cluster, f, l, sum(n)::BIGINT AS size, arg_max(year, n * 10000 + year) AS dominant_year, sum(sx) / sum(n) AS cx, sum(sy) / sum(n) AS cy, min(year) AS first_year,
    coalesce(sum(n) FILTER (WHERE year = l), 0)::BIGINT AS last_count, max(n) AS peak FROM b JOIN s USING (lab) GROUP BY ALL)
  SELECT lab, cluster, size, dominant_year, round(cx, 5) AS cx, round(cy, 5) AS cy, first_year, last_count, peak, first_year > f AS is_new, peak > 0 AND last_count <= peak // 3 AND l <> first_year AS is_declining FROM a""",
    "cohort_transitions": f"WITH {_MOVES} SELECT lab, year, next_year, round(dx, 6) AS dx, round(dy, 6) AS dy, round(distance, 5) AS distance, round(share, 5) AS share, similarity FROM tr",
    "cohort_drift_summary": f"""WITH {_MOVES} SELECT lab, arg_max(year, distance) AS max_jump_year, round(sum(distance), 5) AS path_length, round(max(distance), 5) AS max_jump,
  round(sqrt(sum(dx) ** 2 + sum(dy) ** 2), 5) AS total_drift, round(avg(similarity), 9) AS mean_similarity FROM tr GROUP BY lab""",
    "outlier_scores": f"WITH {_OUT} SELECT lab, id, cluster, round(outlier, 5) AS outlier FROM sc",
    "nearest_centroid_assign": f"""WITH {_POINTS}, {_centroid('cc', '(SELECT * FROM pt WHERE cluster >= 0)', 'lab', 'cluster')},
  b AS (SELECT pt.lab, pt.id, pt.cluster, cc.cluster AS near, row_number() OVER (PARTITION BY pt.id ORDER BY {_COS.format(a='pt.v', b='cc.u')} DESC, cc.cluster) AS rn FROM pt JOIN cc USING (lab))
  SELECT lab, id, CASE WHEN cluster < 0 THEN near ELSE cluster END AS cluster FROM b WHERE rn = 1""",
    "year_cluster_cube": f"WITH {_POINTS} SELECT lab, year, cluster, (grouping(lab) * 4 + grouping(year) * 2 + grouping(cluster))::BIGINT AS level, count(*) AS n FROM pt GROUP BY CUBE (lab, year, cluster)",
}
SQL["dense_vector_pairs"] = f"WITH {_UNIT} SELECT q.id, b.id AS neighbor, round(greatest(0, least(1, list_dot_product(q.v, b.v))), 5) AS similarity FROM u q JOIN u b ON q.id <> b.id WHERE q.id % 50 = 0"
QUERIES = {name: globals()[name] for name in SQL}
