"""Operators of change-impact analysis, each from DataFrames to a DataFrame."""
