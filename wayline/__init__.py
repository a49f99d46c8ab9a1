"""Spark-native building and evaluation of turn-by-turn navigation datasets."""

__version__ = "0.1.0"
