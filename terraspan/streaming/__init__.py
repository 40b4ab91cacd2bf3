"""Incremental versions of aggregates, as Structured Streaming queries."""
