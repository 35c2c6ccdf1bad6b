"""Spark-native analytics over document collections."""
