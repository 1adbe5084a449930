"""Customer-value analytics on Spark: every step takes and returns a DataFrame."""
