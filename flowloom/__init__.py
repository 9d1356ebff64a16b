"""Flow-measurement analytics on PySpark."""
