"""Review analytics as Spark DataFrame operators and jobs."""
