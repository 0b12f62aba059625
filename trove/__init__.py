"""Spark-native recall, record and training-data analytics."""
