"""Tessera: a PySpark-native engine for learning and analytics on attributed graphs."""
