"""Multi-model analytics expressed as Spark DataFrames."""
