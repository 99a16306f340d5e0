"""Vesper: Spark-native analytics over tables of wide vectors, phase records and documents."""

__version__ = "0.1.0"
