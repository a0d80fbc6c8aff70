"""Relational operators of listing resolution: each takes and returns DataFrames, and runs no action of its own."""
