"""Operators for preparing training data; nothing outside this folder imports it (see __spark_entry__.py)."""
