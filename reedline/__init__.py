"""Ordered-sequence and signal analytics on Spark DataFrames."""
