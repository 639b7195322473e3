"""Certified redaction analytics on Spark DataFrames."""
