"""Column-to-column building blocks; all built-in Spark expressions."""
