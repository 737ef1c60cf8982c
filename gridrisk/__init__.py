"""Infrastructure risk ranking as lazy PySpark DataFrame operators."""
