"""Capture-log analytics over Spark DataFrames: records, search, sessions, hygiene, graphs."""
