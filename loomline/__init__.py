"""loomline: labelled-corpus analytics on Spark DataFrames."""
