"""Document-corpus chunking, indexing, retrieval and audit jobs on Spark DataFrames."""
