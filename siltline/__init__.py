"""Siltline: software-history, source-code and logging analytics on Spark DataFrames."""
