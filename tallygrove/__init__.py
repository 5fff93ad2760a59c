"""Exploratory statistics on Spark DataFrames."""
