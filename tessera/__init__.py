"""Spark-native analytics over code chunks, agent memory and coordination tables."""
