"""Sequence-signature analytics on Spark DataFrames."""
