"""mesospark: trajectory statistics and corpus preparation as PySpark jobs."""
