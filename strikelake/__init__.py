"""Option-chain time-series analytics on Spark DataFrames."""
