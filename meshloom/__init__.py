"""Spark-native analytics for unstructured meshes and their fields."""

__version__ = "0.1.0"
