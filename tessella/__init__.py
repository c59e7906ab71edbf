"""Spark-native engine for JPEG-LS image corpora and training-data preparation."""

__version__ = "1.0.0"
