"""Audit many source repositories at once with Spark DataFrames."""
