"""Spark-native operators for evidence-grounded question answering data."""
