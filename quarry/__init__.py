"""Corpus analytics and retrieval as PySpark plans."""
