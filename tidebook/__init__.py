"""Spark-first analytics for order-by-order market data and the record pipelines around it."""

__version__ = "0.1.0"
