"""Sensitive-data analytics on Spark: detect, resolve, redact, restore, report."""
