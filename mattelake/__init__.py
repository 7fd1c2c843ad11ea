"""Batch image-matte analytics as Spark DataFrames."""
