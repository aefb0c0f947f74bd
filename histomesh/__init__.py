"""Spark-native analytics for image-based spatial single-cell data."""

__version__ = "0.1.0"
