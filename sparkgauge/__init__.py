"""Evaluation of structured extraction output, and the data work around it, on Spark."""

__version__ = "0.1.0"
