"""Text and sequence index analytics on Spark DataFrames."""
