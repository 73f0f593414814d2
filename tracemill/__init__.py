"""Spark-native audit engine for reasoning traces."""
