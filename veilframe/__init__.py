"""Reversible pseudonymisation of text collections on Spark DataFrames."""
