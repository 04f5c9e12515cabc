"""Structured Streaming from ticks to bars."""
