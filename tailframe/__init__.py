"""A PySpark engine for market-style time series."""
