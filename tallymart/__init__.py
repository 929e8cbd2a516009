"""Retail sales analytics on Spark: clean, normalise, join, report, forecast."""
