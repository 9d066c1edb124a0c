"""codeweft: code-graph analytics and training-data operators as plain Spark jobs."""
