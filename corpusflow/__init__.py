"""corpusflow: document preparation and retrieval as Spark jobs."""
