"""Tessella: document and source-code similarity, authorship and evaluation analytics as PySpark jobs."""
