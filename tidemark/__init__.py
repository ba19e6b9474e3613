"""Change-impact analytics on Spark DataFrames."""
