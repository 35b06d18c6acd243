"""Document search and analytics on PySpark."""
