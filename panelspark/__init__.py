"""Panel and event-stream analytics on Spark DataFrames."""
