"""Structured Streaming forms of the quota operators."""
