"""Loomdex: content-addressed indexing, synchronisation and vector search on Spark DataFrames."""

__version__ = "0.1.0"
