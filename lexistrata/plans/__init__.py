"""The query language, its compiler to DataFrames, and the registry of named operators."""
