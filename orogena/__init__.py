"""Spark-native analytics over map data."""
