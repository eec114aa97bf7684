"""barlake: market-data analytics on Spark DataFrames."""
