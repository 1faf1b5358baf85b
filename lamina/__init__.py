"""Layered rule data, derivation queries and training-set preparation on Spark DataFrames."""
