"""Multi-scale trees as Spark DataFrames."""
