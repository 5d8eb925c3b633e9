"""Spark-native analytics and boolean text search."""
