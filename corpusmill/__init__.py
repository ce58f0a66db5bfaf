"""Corpus screening and ranking on Spark DataFrames."""
