"""Tesserine: Spark jobs over software-package security evidence and training text."""

__version__ = "0.1.0"
