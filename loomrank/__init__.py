"""Spark-native extraction, scoring, filtering and ranking of semi-structured text."""
