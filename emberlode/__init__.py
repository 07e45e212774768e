"""Spark-native hybrid code search and text retrieval."""
