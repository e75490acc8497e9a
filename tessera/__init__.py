"""Tessera: a PySpark-native engine for entity-equivalence ranking."""
