"""Spark-native analytics over ledgers of graded runs."""
