"""Structured Streaming: collections that grow."""
