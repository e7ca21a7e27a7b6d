"""Spark-native source-to-evidence analytics."""
