"""Spark-native analytics over replicated, content-addressed file namespaces."""

__version__ = "0.1.0"
