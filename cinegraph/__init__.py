"""Spark-native analytics over media knowledge graphs."""
