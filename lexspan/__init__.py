"""Description-to-word retrieval, its evaluation and its user activity, as Spark jobs."""
