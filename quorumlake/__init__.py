"""Analytics over open, community-vetted publishing data, on Spark DataFrames."""
