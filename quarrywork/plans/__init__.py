"""Quarrywork plans."""
