"""Lodeframe: messy tables and text as typed, catalogued, governed Spark DataFrames."""
