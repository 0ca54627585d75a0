"""Spark-native semantic graph and training-data operators."""

__version__ = "0.1.0"
