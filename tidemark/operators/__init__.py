"""Operators over bars, fundamentals and cross-sections."""
