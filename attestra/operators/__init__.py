"""Operators over DataFrames, with column names as parameters."""
