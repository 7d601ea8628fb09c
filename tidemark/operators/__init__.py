"""Jobs: plain functions from DataFrames and run parameters to a DataFrame."""
