"""Spark-native analytics over document corpora and evolving claim ledgers."""
