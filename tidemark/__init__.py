"""Tidemark: a Spark-native engine for replicated, continuously changing tables."""
