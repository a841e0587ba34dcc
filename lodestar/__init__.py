"""Lodestar: place-and-trip analytics as PySpark DataFrame operators."""
