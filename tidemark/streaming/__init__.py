"""Structured Streaming forms of the operators that look at time."""
