"""Spark-first analytics for supplier quotes held as tables of documents, lines and items."""

__version__ = "0.1.0"
