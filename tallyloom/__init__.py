"""Tallyloom: record reconciliation and training-data preparation on Spark DataFrames."""

__version__ = "0.2.0"
