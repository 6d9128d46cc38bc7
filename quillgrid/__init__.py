"""Spark-first analytics over form tables."""
