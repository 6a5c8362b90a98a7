"""Case analytics and document evidence on Spark DataFrames."""
