"""Evolving facts as DataFrames: slot parsing, write policies, lookups, scores and reports on Spark."""
