"""coordspark: a PySpark-native engine for field-coordinate tables."""

__version__ = "0.1.0"
