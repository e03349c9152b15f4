"""fieldbook: history features, statistics and forecasts for panel data, on Spark DataFrames."""

__version__ = "0.1.0"
