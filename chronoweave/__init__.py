"""Spark-native time-series analytics."""

__version__ = "0.1.0"
