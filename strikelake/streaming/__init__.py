"""Structured Streaming versions of the bar and signal pipelines."""
