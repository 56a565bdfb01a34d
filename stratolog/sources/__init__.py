"""Segment files and the framed log."""
