"""Explainable place analytics as PySpark DataFrame code."""
