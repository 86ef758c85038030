"""Hierarchical point clustering on Spark DataFrames."""
