"""Spark-native analytics engine for code-structure graphs and text corpora."""
