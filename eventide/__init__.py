"""Eventide: point-in-time analytics over interaction logs, on Spark DataFrames."""
