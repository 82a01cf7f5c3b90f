"""Corpus-intelligence operators over Spark DataFrames."""
