"""Structured Streaming forms of the row triggers."""
