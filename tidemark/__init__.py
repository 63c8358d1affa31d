"""Document analytics and hybrid retrieval over Spark DataFrames."""
