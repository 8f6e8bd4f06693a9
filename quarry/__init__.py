"""Ranked text and code search, exact search and retrieval evaluation as PySpark DataFrame operators."""
