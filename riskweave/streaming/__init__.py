"""Structured Streaming entry points (uploads scored as they land)."""
