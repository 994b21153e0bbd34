"""Operators over graph tables: DataFrames in, DataFrames out."""
