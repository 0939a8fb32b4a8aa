"""Incremental (Structured Streaming) forms of the statistics."""
