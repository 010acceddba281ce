"""Spark-first analytics over property-style listings."""
