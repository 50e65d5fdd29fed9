"""Log-timeline analytics on Spark DataFrames."""
