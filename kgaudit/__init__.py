"""Spark-native knowledge-graph analytics: sources, functions, operators, plans and streams."""
