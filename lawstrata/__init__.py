"""A PySpark-native engine for structured document collections."""

__version__ = "0.1.0"
