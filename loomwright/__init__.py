"""Loomwright: declarative feature transformation on Spark DataFrames."""
