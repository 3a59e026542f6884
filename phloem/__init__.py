"""phloem: graph-augmented document retrieval and corpus processing on Spark DataFrames."""
