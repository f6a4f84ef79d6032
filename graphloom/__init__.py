"""graphloom: directed-graph analytics on Spark DataFrames."""
