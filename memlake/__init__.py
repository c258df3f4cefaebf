"""Spark-native memory, retrieval and corpus-preparation engine."""
