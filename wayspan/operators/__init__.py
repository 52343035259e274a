"""Operators from DataFrames to DataFrames; column names are parameters."""
