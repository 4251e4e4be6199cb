"""Evidra: records and observations cross-examined with Spark DataFrames."""
