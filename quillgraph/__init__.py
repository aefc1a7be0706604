"""Content-graph queries and training-data operators on Spark DataFrames."""
