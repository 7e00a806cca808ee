"""News and price tape analytics on Spark DataFrames."""
