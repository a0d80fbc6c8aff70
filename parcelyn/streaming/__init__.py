"""Structured Streaming forms of the recurrent reports, with the batch functions' semantics."""
