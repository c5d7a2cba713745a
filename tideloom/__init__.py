"""Windowed streaming-graph queries and related dataset operators on PySpark."""
