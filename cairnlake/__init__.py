"""Hybrid retrieval and dialogue analytics on Spark DataFrames."""
