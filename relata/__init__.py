"""Entity-type relevance scoring and text processing on Spark DataFrames."""
