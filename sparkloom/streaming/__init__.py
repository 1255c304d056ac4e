"""Structured Streaming: index maintenance from a change stream."""
