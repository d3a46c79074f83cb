"""Hybrid recommendation and rating analytics on Spark DataFrames."""
