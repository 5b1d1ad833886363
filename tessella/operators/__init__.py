"""Operators on tokens, regions and interval sets."""
