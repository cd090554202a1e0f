"""Structured Streaming jobs over advertising clicks."""
