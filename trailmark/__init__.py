"""Analytics over recorded agent sessions, as Spark DataFrame jobs."""
