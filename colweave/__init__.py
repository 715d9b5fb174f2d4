"""Column-to-catalog matching and data processing on PySpark."""
