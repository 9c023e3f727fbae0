"""Spark-native archive retrieval and analytics."""
