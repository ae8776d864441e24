"""Spark-native extraction and analytics over captured documents."""
