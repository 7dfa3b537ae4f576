"""Timed-text analytics on Spark: lines, tokens and frames of documents as DataFrames."""
