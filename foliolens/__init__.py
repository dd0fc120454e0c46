"""foliolens: page and document quality as Spark DataFrame jobs."""
