"""spanlake: interval analytics on PySpark."""
