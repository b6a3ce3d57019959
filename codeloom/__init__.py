"""Dependency-graph analytics for code and other node/edge data, on Spark DataFrames."""
