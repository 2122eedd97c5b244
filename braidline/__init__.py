"""Structure analytics over collections of parallel sequences, on PySpark."""
