"""Term co-occurrence analytics and retrieval on Spark DataFrames."""
