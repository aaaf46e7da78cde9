"""Boxloom: Spark-native analytics over model-produced image annotations."""
