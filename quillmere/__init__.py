"""Spark-native corpus retrieval, analytics and training-data operators."""
