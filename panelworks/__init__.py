"""Panel time-series analytics as PySpark DataFrame operators and jobs."""
