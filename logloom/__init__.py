"""Keyed change-log analytics on Spark DataFrames."""
