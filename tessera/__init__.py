"""Data-quality analytics on PySpark: checks, metrics, profiles, suggestions, repairs, models, repositories."""
