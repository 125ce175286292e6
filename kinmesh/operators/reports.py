"""Tables behind cohort and graph reports: grids, statuses, filters, overviews.

Points are (lab, year, id, cluster, x, y, outlier); the cluster -1 is noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of run stages, and shapes of years in a plot.
STAGES = {
    "queued": "Wartet",
    "ingestion": "Submissions laden",
    "normalization": "Code normalisieren",
    "embeddings": "Embeddings berechnen",
    "projection": "2D-Projektion",
    "cluster": "Cluster berechnen",
    "yearStats": "Jahrgänge auswerten",
    "neighbors": "Nachbarschaften berechnen",
    "artifacts": "Artefakte schreiben",
    "published": "Fertig",
    "failed": "Fehler",
}
SHAPES = 8
FIRST_YEAR, LAST_YEAR = 1900, 2200


def stage_label(stage: Column) -> Column:
    """The label of a run's stage; an unknown stage is its own."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), stage), stage)


def heartbeat_age(now: Column, at: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at))


def is_year(year: Column) -> Column:
    return F.coalesce(year.between(FIRST_YEAR, LAST_YEAR), F.lit(False))


def year_of_name(name: Column) -> Column:
    """The first four digits from 1900 to 2099 that stand between other characters, null without any."""
    found = F.regexp_extract(name, r"(?:^|[^0-9])((?:19|20)\d{2})(?:[^0-9]|$)", 1)
    return F.when(found != "", found.cast("int"))


def key_of_name(name: Column) -> Column:
    """A file name as a key: without ending, year or word for one, in small letters joined by _."""
    out = F.regexp_replace(name, r"(?i)\.zip$", "")
    out = F.regexp_replace(out, r"(?:^|[_\-\s])((?:19|20)\d{2})(?:$|[_\-\s])", "_")
    out = F.regexp_replace(out, r"(?i)(?:^|[_\-\s])jahr(?:gang)?[_\-\s]*((?:19|20)\d{2})(?:$|[_\-\s])", "_")
    out = F.regexp_replace(F.regexp_replace(F.lower(out), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", "assignment").otherwise(out)


def natural_key(label: Column) -> Column:
    """A key that sorts as people do: runs of digits by value, whatever their length."""
    parts = F.regexp_extract_all(label, F.lit(r"\d+|\D+"), F.lit(0))

    def padded(p: Column) -> Column:
        # up to 20 digits in 20 places; longer numbers come behind them, by how many digits they have
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(F.length(digits) <= 20, F.lpad(digits, 20, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(digits).cast("string"), 9, "0"), digits))

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), padded(p)).otherwise(p)), "")


def ratio(value: Column, least: Column, most: Column) -> Column:
    """Where a value stands between two others, 0 to 1; 1 where they are one."""
    return F.when(most - least < 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - least, most - least))))


def scaled(points: DataFrame, *keys: str, pad: float = 0.08) -> DataFrame:
    """``points`` with sx and sy: x and y within their padded range of the keys' points, 0.5 where all are one."""
    box = points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    df = points.join(box, list(keys))
    for c in "xy":
        width = F.col(f"max_{c}") - F.col(f"min_{c}")
        low = F.col(f"min_{c}") - pad * width
        df = df.withColumn(f"s{c}", F.when(width < 1e-12, 0.5).otherwise(F.try_divide(F.col(c) - low, width * (1 + 2 * pad))))
    return df.drop("min_x", "max_x", "min_y", "max_y")


def weighted_means(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, centroid): weighted mean of the vectors (keys, place, v, weight) of each key, by dimension.

    Vectors whose size differs from the first one's, by place, are left out; weights of 0 in all give no row.
    """
    size = vectors.filter(F.col("v").isNotNull()).groupBy(*keys).agg(F.min_by(F.size("v"), "place").alias("size"))
    even = vectors.join(size, list(keys)).filter(F.size("v") == F.col("size"))
    sums = even.select(*keys, "weight", F.posexplode("v").alias("d", "x")).groupBy(*keys, "d").agg(F.sum(F.col("x") * F.col("weight")).alias("s"), F.sum("weight").alias("w")).filter(F.col("w") > 0)
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.col("w")).alias("m")))), lambda e: e["m"]).alias("centroid"))


def selected(points: DataFrame, years: list[int] = (), clusters: list[int] = ()) -> DataFrame:
    """Points of the chosen years and clusters; an empty choice is all."""
    df = points.filter(F.col("year").isin(*years)) if years else points
    return df.filter(F.col("cluster").isin(*clusters)) if clusters else df


def found_by(points: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with ``needle`` in any of the columns as text, whatever the case; ordered by year, cluster and id when shown."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.strip().lower())), F.lit(False))
    return points.filter(hit)


def year_cluster_grid(points: DataFrame) -> DataFrame:
    """(lab, year, cluster, n, share, members): a cell for each year and cluster of a lab, empty ones kept; share is of the year."""
    years, clusters = points.select("lab", "year").distinct(), points.select("lab", "cluster").distinct()
    cells = points.groupBy("lab", "year", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("members"))
    grid = years.join(clusters, "lab").join(cells, ["lab", "year", "cluster"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("lab", "year"))
    return grid.withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0))).withColumn("members", F.coalesce("members", F.array().cast(dict(cells.dtypes)["members"])))


def cluster_statuses(artifacts: DataFrame, points: DataFrame) -> DataFrame:
    """``artifacts`` (lab, cluster, is_new, is_declining) with status: new, declining, stable with points in three years or more, else mixed; noise is mixed."""
    years = points.groupBy("lab", "cluster").agg(F.countDistinct("year").alias("years"))
    status = F.when(F.col("cluster") < 0, "mixed").when(F.col("is_new"), "new").when(F.col("is_declining"), "declining").when(F.col("years") >= 3, "stable").otherwise("mixed")
    return artifacts.join(years, ["lab", "cluster"], "left").withColumn("status", status).drop("years")


def year_shapes(points: DataFrame) -> DataFrame:
    """(lab, year, shape): the years of a lab in order take one of eight shapes in turn."""
    years = points.select("lab", "year").distinct()
    return years.withColumn("shape", F.pmod(F.row_number().over(Window.partitionBy("lab").orderBy("year")) - 1, F.lit(SHAPES)).cast("int"))


def overview(points: DataFrame) -> DataFrame:
    """(lab, points, years, clusters, outliers, first_year, last_year); noise is no cluster."""
    return points.groupBy("lab").agg(
        F.count(F.lit(1)).alias("points"), F.countDistinct("year").alias("years"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"),
        F.count_if(F.col("outlier") >= 0.9).alias("outliers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def workspace(labs: DataFrame, runs: DataFrame, artifacts: DataFrame, required: int) -> DataFrame:
    """(lab, run_id, state, reason): labs with their latest published run (lab, run_id, created_at); missing without one or with
    fewer than ``required`` of its artefacts (run_id, name)."""
    latest = runs.groupBy("lab").agg(F.max(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))
    have = artifacts.groupBy("run_id").agg(F.countDistinct("name").alias("have"))
    df = labs.join(latest, "lab", "left").join(have, "run_id", "left")
    reason = F.when(F.col("run_id").isNull(), "no_published_run").when(F.coalesce("have", F.lit(0)) < required, "incomplete_artifacts")
    return df.select("lab", "run_id", F.when(reason.isNull(), "ready").otherwise("missing").alias("state"), reason.alias("reason"))


#: Artefacts without which a published run does not count.
REQUIRED = ("overview", "year_stats", "year_similarity")


def workspace_runs(labs: DataFrame, runs: DataFrame, artifacts: DataFrame, model: str | None = None) -> DataFrame:
    """(lab, run_id, state, reason, lacking): labs with their latest published run, of ``model`` if one is asked for.

    ``runs`` are (lab, run_id, model, created_at), ``artifacts`` (run_id, name). A lab is missing
    without a run, or with one that lacks an artefact of REQUIRED; ``lacking`` names those.
    """
    own = runs if model is None else runs.filter(F.col("model") == model)
    latest = own.groupBy("lab").agg(F.max(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))
    have = artifacts.filter(F.col("name").isin(*REQUIRED)).groupBy("run_id").agg(F.collect_set("name").alias("have"))
    df = labs.select("lab").distinct().join(latest, "lab", "left").join(have, "run_id", "left")
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("have", F.array().cast("array<string>")))
    none = "no_published_run" if model is None else "no_published_run_for_model"
    reason = F.when(F.col("run_id").isNull(), none).when(F.size(lacking) > 0, "published_run_without_complete_artifacts")
    return df.select("lab", "run_id", F.when(reason.isNull(), "ready").otherwise("missing").alias("state"), reason.alias("reason"), F.when(F.col("run_id").isNotNull(), lacking).alias("lacking"))


def workspace_totals(states: DataFrame, points: DataFrame) -> DataFrame:
    """One row: labs ready and missing, and over the ready ones submissions, years and the transitions between a lab's neighbouring years."""
    ready = states.filter("state = 'ready'").select("lab")
    years = points.join(ready, "lab", "left_semi").groupBy("lab", "year").agg(F.count(F.lit(1)).alias("n"))
    after = F.lead("year").over(Window.partitionBy("lab").orderBy("year"))
    moves = years.withColumn("move", F.when(after.isNotNull(), F.concat_ws("-", "year", after)))
    told = moves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("submissions"), F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("move")).alias("transitions"))  # sets of years
    counts = states.agg(F.count_if(F.col("state") == "ready").alias("labs"), F.count_if(F.col("state") == "missing").alias("missing"))
    return counts.crossJoin(told)  # one row each


def cluster_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, cluster, nodes, internal, external): edges of each group of nodes, noise (null cluster) among them; an edge between two groups is external to both."""
    own = members.select("space", "sid", "cluster")
    a, b = own.withColumnsRenamed({"sid": "i", "cluster": "ci"}), own.withColumnsRenamed({"sid": "j", "cluster": "cj"})
    met = edges.select("space", "i", "j").join(a, ["space", "i"]).join(b, ["space", "j"]).withColumn("same", F.col("ci").eqNullSafe(F.col("cj")))
    sides = F.when(F.col("same"), F.array("ci")).otherwise(F.array("ci", "cj"))
    counts = met.select("space", "same", F.explode(sides).alias("cluster")).groupBy("space", "cluster").agg(F.count_if("same").alias("internal"), F.count_if(~F.col("same")).alias("external"))
    nodes = own.groupBy("space", "cluster").agg(F.count(F.lit(1)).alias("nodes"))
    join = (nodes["space"] == counts["space"]) & nodes["cluster"].eqNullSafe(counts["cluster"])
    return nodes.join(counts, join, "left").select(nodes["space"], nodes["cluster"], "nodes", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external"))
