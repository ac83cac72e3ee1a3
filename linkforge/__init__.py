"""Record linkage and candidate retrieval on Spark."""
