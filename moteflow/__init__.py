"""Trajectory analytics on Spark: particle-simulation scans, range joins, windows and result contracts as DataFrames."""
