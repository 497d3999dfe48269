"""Document-layout and annotation analytics on Spark DataFrames."""
