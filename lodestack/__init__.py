"""Document analytics and retrieval operators for Apache Spark."""
