"""Acoustic ranging analytics on PySpark."""
