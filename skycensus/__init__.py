"""Analytics for astronomical survey tables as Spark DataFrame operators."""
