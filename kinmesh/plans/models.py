"""Queries whose results SQL cannot state: density clusters, k-means, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.operators import density as D
from kinmesh.plans.basket import calibrated, nodes_of
from kinmesh.plans.dense import vectors


def hdbscan_clusters(spark, sf_dir):
    w, _, pairs = calibrated(spark, sf_dir)
    return D.density_clusters(nodes_of(w), pairs)


def kmeans_clusters(spark, sf_dir):
    return D.kmeans(vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v")).select("id", "label")


def pca_projection(spark, sf_dir):
    out = D.project(vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v"))
    return out.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


SQL: dict[str, str] = {}
QUERIES = {"hdbscan_clusters": hdbscan_clusters, "kmeans_clusters": kmeans_clusters, "pca_projection": pca_projection}
