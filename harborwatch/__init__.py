"""Spark-native analytics for defensive threat intelligence."""
