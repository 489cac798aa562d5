"""Similarity joins over vectors and text on Spark DataFrames."""
