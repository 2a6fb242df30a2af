"""Analytics of sequential recommendation as PySpark plans."""
