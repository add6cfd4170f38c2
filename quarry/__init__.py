"""File and document analytics on Spark DataFrames."""
