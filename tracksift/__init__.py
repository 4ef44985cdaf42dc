"""Spark-native tracklist extraction, entity matching and corpus processing."""
