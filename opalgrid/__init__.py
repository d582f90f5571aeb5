"""Declarative operator trees compiled to Spark DataFrames."""
