"""Spark-native panel, factor and point-in-time analytics."""
