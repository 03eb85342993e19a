"""Transaction-risk analytics as Spark DataFrame, SQL and streaming jobs."""
