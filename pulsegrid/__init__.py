"""Spark-native analytics for periodicity, tempo and evidence data."""
