"""Spark-native catalogue search over file-system metadata."""
