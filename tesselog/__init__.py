"""Spark-native retrieval, session-log analytics and record shaping."""

__version__ = "0.1.0"
