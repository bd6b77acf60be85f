"""Sequence-to-interval alignment analytics on Spark DataFrames."""
