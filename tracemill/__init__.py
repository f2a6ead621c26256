"""tracemill: a PySpark-native engine for paired text-evaluation logs."""

__version__ = "0.1.0"
