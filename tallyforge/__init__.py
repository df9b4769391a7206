"""Manifest reconciliation and corpus processing on Spark DataFrames."""
