"""Spark-native engine for synchronised text-and-audio data."""
