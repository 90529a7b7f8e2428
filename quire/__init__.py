"""Spark jobs for a source-backed library of books, scans and training text."""
