"""DataFrames from DataFrames."""
