"""Spark-native analytics for language-model datasets and evaluation results."""
