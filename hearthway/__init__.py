"""Spark-native analytics of regional housing costs and commuting burden."""
