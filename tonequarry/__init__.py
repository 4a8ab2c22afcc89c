"""Sound-similarity and listening-history analytics expressed on Spark DataFrames."""
