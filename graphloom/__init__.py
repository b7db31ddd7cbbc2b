"""Graph retrieval analytics on Spark."""
