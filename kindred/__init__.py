"""Kindred: duplicate and near-duplicate analytics on Spark DataFrames."""
