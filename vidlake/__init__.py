"""Spark-native analytics over structured video data."""
