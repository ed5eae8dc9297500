"""Structured Streaming versions of the time-series operators."""
