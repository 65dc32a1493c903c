"""colsieve: a Spark-native scan, prune and aggregate engine for columnar files."""

__version__ = "0.1.0"
