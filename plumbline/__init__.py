"""Spark-native noisy-lookup analytics: normalise, parse, search, score and decide."""

__version__ = "0.1.0"
