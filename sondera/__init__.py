"""Spark-native candidate retrieval, ranking and corpus preparation."""
