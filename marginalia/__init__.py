"""marginalia: document analytics on Spark DataFrames."""
