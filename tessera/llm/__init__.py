"""Operators of a training-data pipeline: deduplication, quality, privacy,
tokenising and mixing, each on Spark DataFrames."""
