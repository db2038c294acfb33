"""Spark-native analytics over block-ordered entity ledgers."""
