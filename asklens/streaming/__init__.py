"""Structured Streaming forms of the running jobs."""
