"""Frames, pixels and time as DataFrames."""
