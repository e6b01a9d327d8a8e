"""Structured Streaming forms of the rate, feedback and threshold counters."""
