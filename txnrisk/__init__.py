"""Payment-transaction risk analytics as Spark jobs."""
