"""Similarity, graph and cohort analytics as Spark plans."""
