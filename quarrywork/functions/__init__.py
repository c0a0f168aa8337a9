"""Quarrywork functions."""
