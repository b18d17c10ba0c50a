"""Structured Streaming versions of the one-pass accumulators."""
