"""Spark-native extraction of legal citations and the data processing around it."""
