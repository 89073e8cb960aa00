"""Spark-native analytics for commerce, event and web-content data."""
