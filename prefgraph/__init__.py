"""Spark-native analytics for pairwise preference data."""
