"""Spark-native analytics over web pages, documents and semi-structured records."""
