"""Rillet: path-and-transform operators over JSON-shaped data, as Spark DataFrame operations."""

__version__ = "0.1.0"
