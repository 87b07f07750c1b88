"""Operators: DataFrames in, DataFrames out. None collects rows."""
