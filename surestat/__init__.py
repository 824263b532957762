"""Confidence analytics for machine-generated diagnosis lists, on Spark."""
