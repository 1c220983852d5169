"""Settlement analytics as Spark jobs."""
