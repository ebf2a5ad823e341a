"""Structured Streaming versions of operators."""
