"""Edit-history analytics and recommendation as Spark DataFrame jobs."""
