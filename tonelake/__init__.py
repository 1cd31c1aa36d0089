"""Analytics over scored text collections and market time series, on Spark DataFrames."""
