"""Spark-native soundscape analytics: operators, sources, functions, plans and streams."""
