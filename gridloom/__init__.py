"""Block-structured volumes and their region graphs as Spark DataFrames."""
