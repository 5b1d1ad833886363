"""Structured Streaming extensions over event streams."""
