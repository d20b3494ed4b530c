"""Spark-native vector analytics: typed collections, search, filters, quantization."""
