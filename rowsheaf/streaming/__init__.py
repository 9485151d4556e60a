"""Structured Streaming versions of the event metrics and counters."""
