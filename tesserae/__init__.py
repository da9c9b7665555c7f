"""Spark-native analytics over code-base facts: graphs, rules, versions, reports."""

__version__ = "0.1.0"
