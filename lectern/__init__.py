"""Lectern: document-change, reporting and training-data analytics as ordinary PySpark programs."""
