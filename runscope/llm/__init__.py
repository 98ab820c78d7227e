"""Operators of a training-data pipeline: each reads DataFrames of texts or vectors and returns DataFrames."""
