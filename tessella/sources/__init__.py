"""Readers and writers: vertical text, region lists, beads, interval dumps."""
