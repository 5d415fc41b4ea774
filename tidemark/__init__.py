"""tidemark: a PySpark-native engine for point-in-time bar data and training-data upkeep."""

__version__ = "0.1.0"
