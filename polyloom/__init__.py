"""Polyploid genotype analytics on Spark DataFrames."""
