"""Retrieval operators: DataFrames in, DataFrames out."""
