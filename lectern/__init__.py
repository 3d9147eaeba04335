"""Parallel-text corpora on Spark: building, aligning, searching and reading them as DataFrames."""
