"""Faultline: application diagnostics and usage analytics on Spark DataFrames."""
