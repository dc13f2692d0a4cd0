"""Tidemark: a Spark-native engine for device telemetry, failure labels and model evaluation."""

__version__ = "0.1.0"
