"""smileforge: a PySpark-native engine for options-market analytics."""

__version__ = "0.1.0"
