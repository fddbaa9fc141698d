"""Spark-native corpus curation and span analytics."""
