"""emberlog: structured event and log analytics on Spark DataFrames."""
