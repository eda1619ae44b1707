"""Operators over DataFrames: search, index, scoring, latency."""
