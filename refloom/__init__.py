"""Reference-data management and corpus analytics on Spark DataFrames."""
