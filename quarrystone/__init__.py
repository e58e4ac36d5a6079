"""Quarrystone: Spark-native analytics over versioned research material."""

__version__ = "0.1.0"
