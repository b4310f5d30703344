"""Spark-native analytics for media quality control."""
