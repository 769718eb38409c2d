"""Spark-first analytics over sequencing reads, positions and variants."""
