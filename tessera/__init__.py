"""Tessera: ordered, nested episode data and training corpora as Spark DataFrames."""
