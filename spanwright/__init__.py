"""Analysis and rewriting of text and source corpora with Spark DataFrames."""
