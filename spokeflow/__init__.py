"""Bike-share station availability on Spark, in batch and in Structured Streaming."""
