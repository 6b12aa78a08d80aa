"""Versioned dataset building blocks for PySpark."""
