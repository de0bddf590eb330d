"""cubeloom: labelled array data, layered models and training logs as Spark DataFrames."""
