"""Event-sourced, access-scoped text and vector retrieval analytics on Spark DataFrames."""
