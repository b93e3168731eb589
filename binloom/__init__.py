"""Spark-native binning engine: counts, composition, distances, clusters and metrics as DataFrame operators."""

__version__ = "0.2.0"
