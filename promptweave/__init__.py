"""Spark-native analysis and restructuring of prompt-entry books."""
