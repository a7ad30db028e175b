"""Loomwright: set-at-a-time evidence and corpus analytics on PySpark."""

__version__ = "0.1.0"
