"""paperweave: scientific-paper search, citation analytics and peer profiles on Spark DataFrames."""
