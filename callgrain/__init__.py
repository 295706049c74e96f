"""Spark-native analytics for tool-call corpora."""
