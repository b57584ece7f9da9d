"""Bulk energy-market evidence analytics on Spark DataFrames."""
