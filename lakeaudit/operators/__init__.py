"""Operators of the audit: each takes DataFrames and gives a DataFrame."""
