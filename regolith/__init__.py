"""Spark-first analytics for image registration, match sets and product catalogues."""
