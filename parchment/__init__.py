"""Parchment: auditing large collections of document packages with PySpark DataFrames."""
