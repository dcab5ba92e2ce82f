"""Spark-native linguistic annotation analytics."""
