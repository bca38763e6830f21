"""Spark-native sequence and microbiome analytics."""

__version__ = "0.1.0"
