"""Data-quality analytics on PySpark."""
