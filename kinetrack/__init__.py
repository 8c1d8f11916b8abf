"""Motion-track analytics on Spark DataFrames."""
