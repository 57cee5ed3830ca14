"""Operators over DataFrames; each is a function from DataFrames to a DataFrame."""
