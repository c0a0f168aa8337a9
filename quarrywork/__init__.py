"""Quarrywork: a PySpark-native engine for document knowledge and operational facts."""
