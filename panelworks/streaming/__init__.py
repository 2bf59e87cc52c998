"""Structured Streaming forms of the table profile and the series continuity state."""
