"""Spark-native exploration of data whose real shape is unknown."""
