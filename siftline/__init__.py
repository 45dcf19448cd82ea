"""Spark-first annotation, ranking, statistics and audit operators."""
