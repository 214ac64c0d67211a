"""Analytics over event trains and sampled signals on Spark DataFrames."""
