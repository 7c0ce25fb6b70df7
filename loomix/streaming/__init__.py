"""Rewrites in Structured Streaming."""
