"""Spark-native equity research engine: sources, functions, operators, plans and streaming over daily bars."""
