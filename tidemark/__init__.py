"""Point-in-time and event-study analytics on Spark DataFrames."""
