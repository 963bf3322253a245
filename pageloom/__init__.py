"""pageloom: a PySpark-native engine for wiki-page analytics and corpus preparation."""

__version__ = "0.1.0"
