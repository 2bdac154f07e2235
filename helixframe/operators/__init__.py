"""Operators over sequence tables: DataFrames in, DataFrames out."""
