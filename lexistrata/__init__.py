"""Lexistrata: full-text search, change capture, key-value and text analytics on Spark DataFrames."""

__version__ = "0.1.0"
