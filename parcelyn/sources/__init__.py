"""Readers and parsers of what sites and services deliver, and writers of what they get."""
