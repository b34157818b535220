"""tidemark: a versioned key-value analytics engine expressed as Spark DataFrames."""
