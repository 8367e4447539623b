"""webspark: a Spark-native engine for web-corpus data processing."""

__version__ = "0.1.0"
