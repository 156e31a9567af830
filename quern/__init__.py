"""quern: document retrieval, evaluation and corpus analytics on Spark DataFrames."""
