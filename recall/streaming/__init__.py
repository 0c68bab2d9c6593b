"""Structured Streaming jobs over review answers."""
