"""Call-network analytics on Spark DataFrames."""
