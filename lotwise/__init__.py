"""Vehicle-market analytics as Spark DataFrame operators."""
