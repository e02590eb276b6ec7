"""graphloom: knowledge-graph and hybrid-retrieval analytics on Spark DataFrames."""
