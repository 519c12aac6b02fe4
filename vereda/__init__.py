"""A Spark-first engine for document collections and time series."""
