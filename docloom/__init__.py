"""Document retrieval, preparation and analytics on Spark DataFrames."""
