"""Sequence and temporal-join analytics for frame-stamped match data, on Spark DataFrames."""
