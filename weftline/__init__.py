"""Spark-native mining, indexing and ranking of semi-structured web data."""
