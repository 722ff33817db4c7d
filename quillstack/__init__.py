"""Corpus analytics and lossless dictionary compression on Spark DataFrames."""
