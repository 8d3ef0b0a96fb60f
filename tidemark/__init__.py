"""Keyed, event-time analytics over event streams and bounded event tables, on Spark."""

__version__ = "0.1.0"
