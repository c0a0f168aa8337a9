"""Quarrywork sources."""
