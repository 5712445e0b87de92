"""Structured Streaming versions of the corpus path."""
