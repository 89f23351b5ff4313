"""Inkwell: full-text search and ranking on Spark DataFrames."""
