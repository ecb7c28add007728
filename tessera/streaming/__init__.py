"""Structured Streaming twins of the polling loops."""
