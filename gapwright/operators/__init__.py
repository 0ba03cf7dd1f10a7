"""Relational building blocks: DataFrames in, one lazy DataFrame out."""
