"""Spark-first analytics over very large discrete state spaces and relational tables."""
