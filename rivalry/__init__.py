"""Analytics on histories of two-sided contests, written as Spark DataFrame jobs."""
