"""Search, ranking and tabular learning over large corpora, on Spark DataFrames."""
