"""Interpretable outlier detection and text-corpus operators on Spark."""
