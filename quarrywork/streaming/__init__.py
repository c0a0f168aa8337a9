"""Quarrywork streaming."""
