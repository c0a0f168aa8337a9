"""Quarrywork operators."""
