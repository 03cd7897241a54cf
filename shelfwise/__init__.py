"""Spark-native catalog analytics: ingestion, merges and publisher reports as DataFrame plans."""
__version__ = "0.1.0"
