"""Longitudinal measurement analytics on Spark DataFrames."""
