"""Lowering of logical operators to DataFrames."""
