"""segquery: temporal-segment retrieval and evaluation on Spark DataFrames."""
