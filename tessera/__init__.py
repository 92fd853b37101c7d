"""Declarative, typed data pipelines on Spark DataFrames."""
