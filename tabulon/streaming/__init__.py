"""Requests compile to plain DataFrame plans, so they run on streaming DataFrames as they are; no operator needs state of its own."""
