"""Operators on event and voice DataFrames."""
