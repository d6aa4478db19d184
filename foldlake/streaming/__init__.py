"""Structured Streaming: edit feeds into a store, live counters."""
