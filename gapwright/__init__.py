"""Curation, data-quality and supply/demand gap analytics on Spark DataFrames."""
