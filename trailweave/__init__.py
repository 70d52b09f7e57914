"""trailweave: a PySpark-native engine for investigating transactions and observations."""

__version__ = "0.1.0"
