"""Sum-product graph analytics on Spark DataFrames."""
