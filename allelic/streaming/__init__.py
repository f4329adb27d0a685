"""Structured Streaming wrappers of the row operators."""
