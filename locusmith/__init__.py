"""Interval, window-feature and evaluation-statistics analytics on Spark DataFrames."""
