"""helixloom: structural-variant analytics on Spark DataFrames."""
