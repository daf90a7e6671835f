"""Demand-driven event exchange and data-processing operators on Spark DataFrames."""
