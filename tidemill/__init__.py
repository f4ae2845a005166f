"""tidemill: a PySpark-native batch analytics engine for retail-style warehouses."""

__version__ = "0.1.0"
