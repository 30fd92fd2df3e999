"""Spark-native analytics over in-vehicle network logs."""
