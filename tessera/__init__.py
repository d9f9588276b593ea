"""Spark-native text retrieval, change tracking and usage analytics."""

__version__ = "0.1.0"
