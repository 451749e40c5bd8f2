"""Kernel forecasting and training-data operators on Spark DataFrames."""
