"""Search over laid-out documents, and text preparation, as Spark jobs."""
