"""recspark: product retrieval and recommendation as Spark DataFrame jobs."""
