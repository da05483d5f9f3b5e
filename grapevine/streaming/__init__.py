"""Structured Streaming forms of the trend and ingest jobs."""
