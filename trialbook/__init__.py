"""Analytics for repeated trials of scenario controllers, as PySpark jobs."""
