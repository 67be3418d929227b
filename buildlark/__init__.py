"""buildlark: build-log and operations analytics as Spark jobs."""
