"""Listing resolution on PySpark: clean, block, score, cluster and merge records of many sources."""
