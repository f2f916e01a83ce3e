"""corvane: document retrieval and knowledge-graph analytics on Spark DataFrames."""
