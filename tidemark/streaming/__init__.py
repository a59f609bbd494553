"""Structured Streaming forms of the window summaries."""
