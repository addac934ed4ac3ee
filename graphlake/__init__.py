"""Spark-native knowledge-graph, retrieval and corpus-processing engine."""
