"""Evidence retrieval and training-data preparation as Spark jobs."""
