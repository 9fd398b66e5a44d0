"""Spark-native analytics over long, time-stamped, multi-stream records."""
