"""Spark-native analytics over annotated text and trees."""
