"""Burdock: Spark-native analytics for personalised-proteome burden tables."""
