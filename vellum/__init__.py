"""Note analytics as Spark jobs."""
