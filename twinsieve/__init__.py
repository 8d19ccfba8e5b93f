"""Spark-native near-duplicate media analytics."""

__version__ = "0.1.0"
