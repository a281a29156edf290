"""Spark-native retrieval, ranking, evaluation and training-data analytics."""
