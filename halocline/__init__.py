"""halocline: density clustering and corpus preparation on Spark DataFrames."""
