"""Panel load forecasting and back-testing on Spark DataFrames, keyed by ``series_id``."""
