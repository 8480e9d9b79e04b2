"""Connectivity, signal and sample analytics as PySpark DataFrame operators."""
