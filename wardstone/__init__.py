"""Content-safety analytics for Spark DataFrames."""
