"""Spark-native corpus, token and instruction-data engine."""
