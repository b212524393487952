"""offerlens: product offers, price history and collection analytics as Spark DataFrame transforms."""
