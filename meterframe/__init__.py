"""meterframe: panel time-series preparation, profiling, splitting,
forecasting by key and forecast evaluation on Spark DataFrames."""

__version__ = "0.1.0"
