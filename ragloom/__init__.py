"""ragloom: retrieval, process-graph and evaluation analytics as Spark DataFrame jobs."""
