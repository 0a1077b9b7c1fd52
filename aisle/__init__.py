"""Store sales, stock and risk analytics as Spark DataFrame jobs."""
