"""Spark-native analytics over ordered price bars, and corpus operators in ``llm``."""
