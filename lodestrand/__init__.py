"""Environmental time-series and panel statistics as Spark DataFrame operations."""
