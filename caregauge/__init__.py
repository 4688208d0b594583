"""Provider performance analytics as PySpark DataFrame functions."""
