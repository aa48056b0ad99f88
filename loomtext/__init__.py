"""Loomtext: a Spark-native engine for document preparation."""
