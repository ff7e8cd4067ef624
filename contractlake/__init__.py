"""Spark-native analytics over large collections of contracts and similar documents."""
